"""Best-fit packing by a plan over the histogram of lengths.

Texts are tokenised into pieces of at most `capacity` tokens. Only the histogram of piece lengths (at
most `capacity` rows, whatever the input) reaches the driver, where sequences are planned by best fit
over counts: lengths from long to short, each into the open sequences with the least room that takes it, all
sequences of the same room at once. Pieces then take planned slots by their rank among the pieces of the same
length. A piece is numbered among its task's pieces of the same length as it is cut, so ranks need the counts by
task and length alone; neither pieces nor ids are moved for the sake of the plan where those are few.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, batch_of, runs, table, texts

#: The byte-level pre-tokenizer's public pattern.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BROADCAST_BYTES = 64 << 20
"""The tasks' counts by length are broadcast up to so many bytes (8,192 tasks at a capacity of 1,024)."""

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_encoders: dict[str, object] = {}


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """A function text -> ids for a tokenizers .json file.

    Where the file is byte-level BPE whose merges are in the order of their ids, the same vocabulary runs
    as ranks in tiktoken, which gives the same ids several times faster; else the file's own library runs.
    """
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre == pre | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = plain and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
    added = spec.get("added_tokens", [])
    plain = plain and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
    if plain:
        vocab, ids = model["vocab"], []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            ids.append(vocab[a + b])
        plain = ids == sorted(ids)
    if plain:
        import tiktoken

        letters, special = _byte_letters(), {t["content"]: t["id"] for t in added}
        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in special}
        own = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        out = lambda text: own.encode_to_numpy(text, allowed_special="all")
    else:
        whole = Tokenizer.from_file(path)
        out = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return _encoders.setdefault(path, out)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole pieces, and before them what is left over."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids; _task and _number, the
    piece's place among those of its task with the same length.

    Null and empty texts give one piece that holds only the end token.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task = encoder(tokenizer_path), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                rows: list[tuple] = []
                for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                    ids = np.append(encode(text), end_id).astype("<u4")
                    for i, (start, n) in enumerate(cuts(len(ids), capacity)):
                        part = ids[start : start + n]
                        rows.append((doc_id, i, start, n, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
                cols = list(zip(*rows, strict=True))
                out = {"doc_id": pa.array(cols[0], pa.int64()), "piece": pa.array(cols[1], pa.int32())}
                out |= {n: pa.array(c, pa.int64()) for n, c in zip(("start", "length", "ids_crc32"), cols[2:5], strict=True)}
                if with_ids:
                    out["ids"] = pa.array(cols[5], pa.list_(pa.int32()))
                length = np.array(cols[3], np.int64)
                order = np.argsort(length, kind="stable")
                there, begin, end = runs(length[order])
                number = np.empty(len(length), np.int64)
                number[order] = np.arange(len(length)) - np.repeat(begin, end - begin) + np.repeat(met[there], end - begin)
                met[there] += end - begin
                yield batch_of(**out, _task=np.full(len(length), task, np.int32), _number=number)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else "") + ", _task int, _number long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts: rows (length, first rank, slots, copies, first sequence, offset of the first copy).

    Lengths go from long to short. A piece goes to the open sequence with the least room that takes it, and stays with
    that sequence while it takes further pieces of the length, as it then has the least room of all; a new sequence is
    opened if none takes it. Sequences of the same room are one run of numbers (first, how many), filled at once.
    """
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms = np.zeros(capacity + 1, np.int64)  # open sequences by room
    out: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def fill(first: int, many: int, copies: int, room: int, length: int = length) -> None:
            nonlocal left, rank
            out.append((length, rank, many * copies, copies, first, capacity - room))
            rank += many * copies
            left -= many * copies
            if rest := room - copies * length:
                open_.setdefault(rest, []).append((first, many))
                rooms[rest] += many

        def take(first: int, many: int, room: int, length: int = length) -> None:
            """Fills of `many` sequences as many as the pieces left ask for; the others stay as they are."""
            copies = room // length
            whole = min(many, left // copies)
            if whole:
                fill(first, whole, copies, room)
            if whole < many and left:
                fill(first + whole, 1, left, room)
                whole += 1
            if whole < many:
                open_.setdefault(room, []).append((first + whole, many - whole))
                rooms[room] += many - whole

        for room in (np.flatnonzero(rooms[length:]) + length).tolist() if left else ():
            runs_, open_[room], rooms[room] = open_[room], [], 0
            for first, many in runs_:
                take(first, many, room)
        if left:
            many = -(-left // (capacity // length))
            take(sequences, many, capacity)
            sequences += many
    return out


def pack(found: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces (kept rows of `pieces`, with a length from 1 to `capacity`)."""
    scratch = Scratch(found.sparkSession, "ranks")
    sizes = scratch.keep(found.groupBy("length", "_task").agg(F.count("*").alias("_n")))
    counts = {int(r[0]): int(r[1]) for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    slots = np.array(plan(counts, capacity) or np.zeros((0, 6)), dtype=np.int64).reshape(-1, 6)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    # By task one list: how many pieces of each length the tasks before it have.
    tasks = sizes.select("_task").distinct()
    grid = tasks.select("_task", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(capacity).cast("long"))).alias("length")).join(sizes, ["_task", "length"], "left")
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lists = grid.select("_task", F.struct("length", earlier.alias("n")).alias("x")).groupBy("_task").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["n"]).alias("_before"))
    # Few tasks: their lists are broadcast, and no piece moves.
    few = tasks.count() * 8 * capacity <= BROADCAST_BYTES
    lists = scratch.keep(lists)
    ranked = found.join(F.broadcast(lists) if few else lists.hint("merge"), "_task").withColumn("_rank", F.element_at("_before", F.col("length").cast("int")) + F.col("_number"))
    names = [c for c in found.columns if c not in ("_task", "_number")]
    far = np.int64(1) << np.int64(48)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = slots[:, 0] * far + slots[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "_rank"))
            s = slots[np.searchsorted(keys, length * far + rank, side="right") - 1]
            k = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(s[:, 4] + k // s[:, 3]), pa.array(s[:, 5] + k % s[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields if f.name in names)
    return ranked.select(*names, "_rank").mapInArrow(seat, f"{schema}, sequence_id long, offset long")


def best_fit_packing(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Documents (doc_id, text) packed into sequences of at most `capacity` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset. Every token is
    kept: a text longer than `capacity` is cut, its first piece may be shorter (a very long one gives as many
    pieces as it fills). Null text: empty (the end token alone); a null id stays null; an empty table gives no
    rows; repeated rows are packed as often as they occur; pieces of equal length are told apart by their place
    in the written table, so ties need no rule; further columns are not looked at.
    """
    found = Scratch(spark, "packing").keep(pieces(docs, tokenizer_path, capacity, end_id, with_ids))
    return pack(found, capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit_packing(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))
