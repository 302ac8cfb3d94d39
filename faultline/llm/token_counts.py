"""Token counts by byte-pair merging, without emitting identifiers.

Each text is cut where no piece of the vocabulary can reach across: before a run of word-start marks, around line feeds
when no piece holds one, and between characters that stand together in no piece. In each part the symbols form a doubly
linked list and a heap holds the mergeable adjacent pairs: the lowest rank (highest score), leftmost first, is merged
until none is left. The count is symbols minus merges, where a symbol unknown to the vocabulary stands for its UTF-8
bytes. Parts repeat, so their counts are kept in bounded caches per Python worker.

Defined cases: null and empty texts have 0 tokens; strings that look like special tokens are ordinary text;
repeated rows give repeated rows; an empty table gives none; no text is truncated.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_map

MARK = "▁"
CACHE_ENTRIES, CACHED_CHARS, LIMIT = 400_000, 64, 4096


class Merger:
    """Counts the pieces of one part; ``scores`` maps a piece to its score, higher merged first."""

    def __init__(self, scores: dict[str, float]) -> None:
        order = {x: i for i, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: order[x] for p, x in scores.items()}
        #: Characters that stand alone in the vocabulary cost one token when unmerged, others one per byte.
        self.known = {p for p in scores if len(p) == 1}

    def count(self, part: str) -> int:
        rank_of, n = self.ranks.get, len(part)
        symbols: list[str | None] = list(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # a heap of rank * n + place orders by rank, then from the left; whether an entry still holds shows when it is popped
        heap = [r * n + i for i in range(n - 1) if (r := rank_of(part[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            left, j = symbols[i], after[i]
            if left is None or j >= n:
                continue
            pair = left + symbols[j]
            if rank_of(pair) != rank:
                continue
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(pair + symbols[k])) is not None:
                    heapq.heappush(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbols[h] + pair)) is not None:
                heapq.heappush(heap, r * n + h)
            merges += 1
        known = self.known
        extra = sum(len(s.encode()) - 1 for s in symbols if s is not None and s not in known and len(s) == 1)
        return n - merges + extra


class _Atoms(dict):
    """run of symbols no merge can cut off -> count; long runs are counted but not kept, a full cache starts anew."""

    def __init__(self, merger: Merger) -> None:
        super().__init__()
        self.merger = merger

    def __missing__(self, part: str) -> int:
        n = self.merger.count(part)
        if len(part) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[part] = n
        return n


class _Parts(dict):
    """part -> count, by cutting it between symbols that stand together in no piece of the vocabulary."""

    def __init__(self, atoms: _Atoms, joined: set[str], prefix: str) -> None:
        super().__init__()
        self.atoms, self.joined, self.prefix = atoms, joined, prefix

    def __missing__(self, part: str) -> int:
        whole, joined, atoms = self.prefix + part, self.joined, self.atoms
        n = begin = 0
        for i in range(1, len(whole)):
            if whole[i - 1 : i + 1] not in joined:
                n += atoms[whole[begin:i]]
                begin = i
        n += atoms[whole[begin:]]
        if len(part) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[part] = n
        return n


#: Texts on which other model types, normalisers or pieces of the user's own would show: words that a unigram model cuts
#: otherwise, ligatures and wide letters, runs of blanks, symbols of control pieces.
PROBES = ("An unbelievable misunderstanding of internationalisation", "ﬁ Ａｂ e\u0301 ½ ™", "  two   runs  ", "a\tb\nc", "<s> </s> <unk> [INST] <pad>", "北京 😀")


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[str], int]:
    """text -> number of tokens for a BPE ``.model`` file whose normalizer leaves characters alone; a file that counts otherwise is refused."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    scores = {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    }
    for piece in scores:
        if MARK in piece.lstrip(MARK) or "\n" in piece or " " in piece:
            raise ValueError(f"a piece of this vocabulary crosses word starts: {piece!r}")
    merger = Merger(scores)
    joined = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
    atoms = _Atoms(merger)
    first, later = _Parts(atoms, joined, ""), _Parts(atoms, joined, MARK)
    feed = merger.count("\n")

    def count(text: str) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        lines = (" " + text).split("\n")
        total = feed * (len(lines) - 1)
        if "  " in lines[0] or "  " in text:
            for line in lines:
                total += runs(line)
            return total
        for line in lines:
            words = line.split(" ")
            head = words[0]
            if head:
                total += first[head]
            if len(words) > 1:
                del words[0]
                total += sum(map(later.__getitem__, words))
        return total

    def runs(line: str) -> int:
        """As above where marks may stand in runs: a run and the word after it are one part."""
        total, held = 0, 0
        for i, word in enumerate(line.split(" ")):
            held += i > 0
            if word:
                total += later[word] if held == 1 else first[MARK * held + word]
                held = 0
        return total + (first[MARK * held] if held else 0)

    special = [model.id_to_piece(i) for i in range(model.get_piece_size()) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
    for probe in (*PROBES, *special[:100]):
        if count(probe) != len(model.encode(probe)):
            raise ValueError(f"{path} is no plain byte-pair model: {probe!r} is counted otherwise")
    return count


def token_counts(docs: DataFrame, id_name: str, text_name: str, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, one row per document."""

    def make():
        count = counter(model)

        def score(texts):
            n_bytes = [len(t.encode()) if t else 0 for t in texts]
            n_tokens = [count(t) if t else 0 for t in texts]
            return n_bytes, n_tokens, [n > limit for n in n_tokens]

        return score

    return text_map(docs, F.col(text_name), [F.col(id_name).alias("doc_id")], "n_bytes long, n_tokens long, over_limit boolean", make)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))
