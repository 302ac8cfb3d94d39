"""Cost-balanced packing of tokenized documents into fixed-length training sequences.

Attention is paid within a document, so a sequence costs ``sum(linear * n + quadratic * n^2)`` over its pieces.
Documents are taken in descending length and each goes to the cheapest sequence that still has room for it; where none
has, a new one is opened. A document is cut only where that is needed: into full sequences when it is longer than one,
and when its sequence is given up to keep padding down: a block ends with at most ``1 + SLACK`` times the fewest
sequences that hold its tokens, so it pads at most that share and one sequence.

Blocks are made inside the task that tokenizes: no shuffle, no grouping key that could be hot, and memory bounded
by ``BLOCK_TOKENS``. Token ids come from the vocabulary file; texts made of characters below U+0250 take a faster
encoder built from the same file, everything else the file's own library, with equal ids.

Defined cases: a null text is an empty one; an empty text is a document of the single end id; repeated rows are
packed as often as they occur; ties in length go by input order; an empty table gives no rows. Other columns of
the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

LENGTH, END_ID, BLOCK_TOKENS = 1024, 0, 1 << 21
#: A block closes at so many documents too: each is an array of its own, however short.
BLOCK_DOCS = 1 << 18
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Sequences a block may end with beyond the fewest possible, as a share of them.
SLACK = 0.01
LONG_TEXT = 1_000_000


#: How the quick encoder splits a text before merging; the byte-level splitting that vocabulary files name.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def is_plain(file: dict) -> bool:
    """Whether the quick encoder gives a vocabulary file's ids: byte-level splitting and nothing else, ids in the order
    of the merges, added tokens that are matched literally."""
    split, model = file.get("pre_tokenizer") or {}, file["model"]
    if file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or any(model.get(x) for x in odd):
        return False
    if any(t.get(x) for t in file.get("added_tokens", ()) for x in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    vocab = model["vocab"]
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    ids = [vocab.get(m, -1) for m in made]
    added = {t["content"] for t in file.get("added_tokens", ())}
    return ids == sorted(set(ids)) and {t for t in vocab if len(t) > 1} - added == set(made) and sum(len(t) == 1 for t in vocab) == 256


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids of a vocabulary file (``.json``), no special tokens added. Files that are not plain byte-level merges
    go through their own library."""
    library: list = []  # the file's own library, loaded by the first text that needs it

    def by_library(text: str) -> np.ndarray:
        if not library:
            from tokenizers import Tokenizer

            library.append(Tokenizer.from_file(path))
        return np.asarray(library[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if not is_plain(file):
        return by_library

    import tiktoken

    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    # The file writes each byte as a printable character: printable Latin-1 stands for itself, the rest follow U+0100.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}
    quick = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    odd = re.compile("[^\x00-\u024f]")
    allowed = set(special)

    def ids(text: str) -> np.ndarray:
        if len(text) > LONG_TEXT or odd.search(text):
            return by_library(text)
        return np.asarray(quick.encode(text, allowed_special=allowed, disallowed_special=()), dtype=np.uint32)

    return ids


def balance(lengths: np.ndarray, length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC, slack: float = SLACK):
    """Assigns items to sequences: in descending order, each to the sequence of lowest cost that has room for it, ties
    to the one opened first, or to a new sequence where none has. Then sequences are given up, the emptiest first, while
    more than ``1 + slack`` times the fewest possible are open: their items are cut into the rooms of the others.

    Returns pieces ``(item, begin, size, sequence, offset)``; every token of every item lies in exactly one, and an
    item of at most ``length`` tokens is cut only when its sequence is given up.
    """
    total = int(lengths.sum())
    fewest = -(-total // length)
    room, cost, held = np.zeros(256, dtype=np.int64), np.zeros(256), []

    def put(item: int, begin: int, size: int, s: int) -> None:
        held[s].append((item, begin, size))
        room[s] -= size
        cost[s] += linear * size + quadratic * size * size

    for item in np.argsort(-lengths, kind="stable"):
        begin, left = 0, int(lengths[item])
        while left:
            size = min(left, length)
            n = len(held)
            s = int(np.argmin(np.where(room[:n] >= size, cost[:n], np.inf))) if n else 0
            if not n or room[s] < size:
                s = n
                if n == len(room):
                    room, cost = np.append(room, np.zeros(n, dtype=np.int64)), np.append(cost, np.zeros(n))
                held.append([])
                room[s] = length
            put(int(item), begin, size, s)
            begin, left = begin + size, left - size
    n = len(held)
    spare = max(0, n - max(fewest, int(fewest * (1 + slack))))
    gone = np.argsort(-room[:n], kind="stable")[:spare]
    room[gone] = 0
    moved = sorted((piece for s in gone for piece in held[s]), key=lambda x: (-x[2], x[0], x[1]))
    for s in gone:
        held[s] = []
    for item, begin, left in moved:
        while left:
            fits = np.flatnonzero(room[:n] >= left)
            s = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room[:n]))
            size = min(left, int(room[s]))
            put(item, begin, size, s)
            begin, left = begin + size, left - size
    out = []
    for s, pieces in enumerate(x for x in held if x):
        offset = 0
        for item, begin, size in pieces:
            out.append((item, begin, size, s, offset))
            offset += size
    return out


def pack(
    docs: DataFrame, id_name: str, text_name: str, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, slack: float = SLACK
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens (before padding)."""
    source = docs.select(F.col(id_name).cast("long").alias("doc_id"), F.col(text_name).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
    names = [x.split()[0] for x in schema.split(", ")]

    def crc(ids: np.ndarray) -> int:
        return zlib.crc32(ids.astype("<u4", copy=False).tobytes())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        base = TaskContext.get().partitionId() << 36
        opened = 0
        rows: list[tuple] = []
        held: list[tuple[int | None, int, np.ndarray]] = []  # (doc, ids before the rest, the rest)
        weight = 0

        def close() -> None:
            nonlocal opened, held, weight
            sizes = np.array([len(x[2]) for x in held], dtype=np.int64)
            pieces = balance(sizes, length, slack=slack)
            filled: dict[int, int] = {}
            for _, _, size, s, _ in pieces:
                filled[s] = filled.get(s, 0) + size
            for item, begin, size, s, offset in pieces:
                doc, before, ids = held[item]
                rows.append((doc, before + begin, size, crc(ids[begin : begin + size]), before + len(ids), base + opened + s, offset, filled[s]))
            opened += len(filled)
            held, weight = [], 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names), names=names)
            rows.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), (x for _, some in slices(batch.column(1)) for x in some), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype(np.uint32)
                whole = len(ids) // length * length
                for at in range(0, whole, length):
                    rows.append((doc, at, length, crc(ids[at : at + length]), len(ids), base + opened, 0, length))
                    opened += 1
                if whole < len(ids):
                    held.append((doc, whole, ids[whole:].copy()))  # a view would keep the whole document
                    weight += len(ids) - whole
                if weight >= BLOCK_TOKENS or len(held) >= BLOCK_DOCS:
                    close()
                if len(rows) >= 20_000:
                    yield flush()
        if held:
            close()
        yield flush()
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
