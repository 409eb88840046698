"""Alignment of two tokenizers: which ids of one stand for which ids of the other, counted over a corpus.

Two tokens are linked where their byte ranges overlap.  Counting is external:

1. Every task tokenises its texts and spills (pair, document) records as runs: radix-partitioned by the id of the second side,
   sorted side-major (second id, first id, document) and compressed with zstd.  A run's head holds its pairs and their totals,
   its body the documents of each pair.  Runs go to a table in the shared folder.
2. The heads of a radix partition are merged with a heap over their frames; merges of many runs go by rounds of a fixed fan-in.
   As pairs leave the last merge side by side, the highest count of each second id is known when its last pair has passed.
3. Counts and maxima are streamed back over the bodies, which are dealt out in slices of bounded size, however much of the corpus one id
   holds; the contributions of a run are two numbers per document of that run.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import arrow_map, kept_by_worker
from claimloom.session import durable, shared_folder

# Radix partitions of the second side's ids.
RADIX = 64
# A run is closed at so many links or documents.
RUN_LINKS = 2_000_000
RUN_DOCUMENTS = 1 << 14
# Runs one merge takes on average, entries of a frame, bytes of bodies in a slice, characters aligned at once.
FAN_IN = 256
FRAME = 4096
SLICE_BYTES = 16 << 20
CHUNK_CHARS = 1 << 20

# The published split pattern of byte-level BPE and the mark of a blank in pieces.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_BLANK = "▁"
# end of fixed values

_INT = np.dtype("<i8")


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as a zstd frame; bytes of equal weight stand together, which is what compresses."""
    planes = [np.ascontiguousarray(a.astype(_INT).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, arrays: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(arrays, 8, -1)
    return [np.ascontiguousarray(a.T).view(_INT).ravel() for a in raw]


def _frames(*arrays: np.ndarray) -> list[bytes]:
    """Frames of sorted entries; the first array is stored as differences."""
    out = []
    for at in range(0, len(arrays[0]), FRAME):
        keys, *rest = (a[at : at + FRAME] for a in arrays)
        out.append(_pack(np.diff(keys, prepend=0), *rest))
    return out


def _read_frames(frames: Iterable[bytes], arrays: int) -> Iterator[list[np.ndarray]]:
    for frame in frames:
        keys, *rest = _unpack(frame, arrays)
        yield [np.cumsum(keys), *rest]


def merge_runs(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merge sorted runs of (pair, total) frames: pairs in order, each once, with the sum of its totals.

    The heap holds, for every open run, the last pair of its current frame; all entries up to the smallest of them are complete.
    """
    readers = [_read_frames(r, 2) for r in runs]
    current: dict[int, list[np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def refill(i: int) -> None:
        frame = next(readers[i], None)
        if frame is not None:
            current[i] = frame
            heapq.heappush(heap, (int(frame[0][-1]), i))

    for i in range(len(runs)):
        refill(i)
    while heap:
        bound = heap[0][0]
        keys, totals = [], []
        for i, (k, t) in list(current.items()):
            cut = int(np.searchsorted(k, bound, "right"))
            if cut:
                keys.append(k[:cut])
                totals.append(t[:cut])
                current[i] = [k[cut:], t[cut:]]
        while heap and heap[0][0] == bound:
            i = heapq.heappop(heap)[1]
            del current[i]
            refill(i)
        k, t = np.concatenate(keys), np.concatenate(totals)
        order = np.argsort(k, kind="stable")
        k, t = k[order], t[order]
        first = np.flatnonzero(np.diff(k, prepend=k[0] - 1))
        yield k[first], np.add.reduceat(t, first)


def with_maxima(merged: Iterable[tuple[np.ndarray, np.ndarray]], low_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, count, is highest of its second id) of pairs that come second id by second id.

    Only the pairs of the id that may go on are held back: at most one entry per id of the first side.
    """
    held_k, held_t = np.zeros(0, _INT), np.zeros(0, _INT)
    for k, t in merged:
        held_k, held_t = np.concatenate([held_k, k]), np.concatenate([held_t, t])
        side = held_k >> low_bits
        done = int(np.searchsorted(side, side[-1]))
        if done:
            yield (held_k[:done], held_t[:done], _highest(side[:done], held_t[:done]))
            held_k, held_t = held_k[done:], held_t[done:]
    if len(held_k):
        yield held_k, held_t, _highest(held_k >> low_bits, held_t)


def _highest(side: np.ndarray, counts: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.diff(side, prepend=side[0] - 1))
    top = np.maximum.reduceat(counts, first)
    return counts == np.repeat(top, np.diff(first, append=len(side)))


def byte_alphabet() -> dict[str, int]:
    """The characters byte-level vocabularies write bytes with: visible Latin-1 characters stand for themselves, the other
    bytes follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, their token bytes, and the alignment of many texts at once."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(byte_level, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        # ids are the order of the merges, so they serve as ranks
        self.first = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            is_byte = self.second.is_byte(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if is_byte else piece.replace(PIECE_BLANK, " ").encode("utf-8"))
        self.a_len = np.array([len(t) for t in self.a_bytes])
        self.b_len = np.array([len(t) for t in self.b_bytes])
        self.a_bits = int(len(self.a_bytes) - 1).bit_length()
        self.b_bits = int(len(self.b_bytes) - 1).bit_length()
        ids = np.arange(max(len(self.a_bytes), len(self.b_bytes)))
        digits = np.array([list(f"{i:>5d}".encode()) for i in ids], dtype=np.uint8)
        self.digits = np.concatenate([np.where(digits == 32, 0, digits), np.zeros((len(ids), 1), np.uint8)], axis=1)

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; no ids where a text is null or empty or one side does not spell it."""
        full = [t or "" for t in texts]
        a = [self.first.encode_ordinary(" " + t) if t else [] for t in full]
        b = self.second.encode(full, num_threads=1)
        for i, t in enumerate(full):
            spelled = (" " + t).encode("utf-8", "surrogatepass")
            if not t or b"".join(map(self.a_bytes.__getitem__, a[i])) != spelled or b"".join(map(self.b_bytes.__getitem__, b[i])) != spelled:
                a[i], b[i] = [], []
        return a, b

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Per text: n_a, n_b, n_groups, n_links, groups_sha256.  Per link: text, a, b.

        All texts lie one behind the other on one axis of bytes, where a flag stands at the end of every token.  Each stretch between
        two neighbouring flags lies in exactly one token of each side, and no two stretches in the same two: stretches are links.
        """
        a_lists, b_lists = self.encode(texts)
        n_a, n_b = np.array([len(x) for x in a_lists]), np.array([len(x) for x in b_lists])
        a, b = (np.fromiter((i for x in lists for i in x), _INT, int(n.sum())) for lists, n in ((a_lists, n_a), (b_lists, n_b)))
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        size = int(a_ends[-1]) + 1 if len(a) else 1
        at_a, at_b = np.zeros(size, bool), np.zeros(size, bool)
        at_a[a_ends], at_b[b_ends] = True, True
        ends = np.flatnonzero(at_a | at_b)
        both = at_a[ends] & at_b[ends]
        ia = np.cumsum(at_a[ends]) - at_a[ends]
        ib = np.cumsum(at_b[ends]) - at_b[ends]
        text_of_a = np.repeat(np.arange(len(texts)), n_a)
        text = text_of_a[ia] if len(ia) else np.zeros(0, np.int64)
        count = lambda x: np.bincount(x, minlength=len(texts))
        return {"n_a": n_a, "n_b": n_b, "n_groups": count(text[both]), "n_links": count(text), "text": text, "a": a[ia], "b": b[ib],
                "groups_sha256": self._digests(a, b, at_a, at_b, a_ends, b_ends, n_a, n_b)}

    def _digests(self, a, b, at_a, at_b, a_ends, b_ends, n_a, n_b) -> list[str]:
        """SHA-256 of the groups in decimal: all tokens are laid out group by group, the first side ahead of the second."""
        common = at_a & at_b
        group = np.cumsum(common) - common
        ga, gb = group[a_ends], group[b_ends]
        groups = int(common.sum())
        a_in, b_in = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        slot_a = np.arange(len(a)) + (np.cumsum(b_in) - b_in)[ga]
        slot_b = np.arange(len(b)) + np.cumsum(a_in)[gb]
        cells = np.empty((len(a) + len(b), self.digits.shape[1]), np.uint8)
        cells[slot_a], cells[slot_b] = self.digits[a], self.digits[b]
        last_a, last_b = np.diff(ga, append=groups) != 0, common[b_ends]
        cells[slot_a, -1] = np.where(last_a, ord("|"), ord(","))
        cells[slot_b, -1] = np.where(last_b, ord(";"), ord(","))
        written = np.cumsum((cells != 0).sum(axis=1))
        flat = cells.ravel()
        flat = memoryview(flat[flat != 0].tobytes())
        tokens = np.cumsum(n_a + n_b)
        stops = np.where(tokens > 0, written[tokens - 1], 0) if len(written) else np.zeros(len(tokens), np.int64)
        out, start = [], 0
        for stop, n in zip(stops.tolist(), n_a.tolist()):
            out.append(hashlib.sha256(flat[start : stop - 1]).hexdigest() if n else "")
            start = stop
        return out


class _Run:
    """Records of the documents of one run until it is closed."""

    def __init__(self, tok: Tokenizers, radix: int):
        self.tok, self.radix = tok, radix
        self.keys, self.links, self.documents = [], 0, 0

    def add(self, aligned: dict) -> np.ndarray:
        """Numbers of the documents in this run."""
        n = len(aligned["n_a"])
        b = aligned["b"].astype(_INT)
        # the radix digit stands above the id
        key = (((b % self.radix << self.tok.b_bits | b) << self.tok.a_bits | aligned["a"]) << _ORD_BITS) | (aligned["text"] + self.documents)
        self.keys.append(key)
        self.links += len(key)
        self.documents += n
        return np.arange(self.documents - n, self.documents)

    def parts(self) -> Iterator[tuple[int, list[bytes], bytes]]:
        """(radix partition, head frames, body) of the run, sorted side-major."""
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, _INT)
        keys.sort()
        if not len(keys):
            return
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        times, keys = np.diff(first, append=len(keys)), keys[first]
        pair = keys >> _ORD_BITS
        part = pair >> (self.tok.a_bits + self.tok.b_bits)
        cuts = np.searchsorted(part, np.arange(self.radix + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            mine = slice(cuts[p], cuts[p + 1])
            k, t = pair[mine], times[mine]
            at = np.flatnonzero(np.diff(k, prepend=k[0] - 1))
            yield p, _frames(k[at], np.add.reduceat(t, at)), _pack(np.diff(k, prepend=0), keys[mine] & ((1 << _ORD_BITS) - 1), t)


_ORD_BITS = 16


def spill(df: DataFrame, byte_level: str, pieces: str, id_col: str, text_col: str, radix: int, run_links: int, run_documents: int) -> DataFrame:
    """Rows of documents (``part`` null) and of runs: run, part, head, body."""
    if run_documents > 1 << _ORD_BITS:
        raise ValueError(f"a run holds at most {1 << _ORD_BITS} documents")
    numbers = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches):
        from pyspark import TaskContext

        tok = kept_by_worker(("alignment", byte_level, pieces), lambda: Tokenizers(byte_level, pieces))
        number, open_run = TaskContext.get().partitionId() << 24, _Run(tok, radix)

        def close():
            parts = list(open_run.parts())
            return {"run": [number] * len(parts), "part": [p for p, *_ in parts], "head": [h for _, h, _ in parts], "body": [b for *_, b in parts],
                    **{n: [None] * len(parts) for n in ("ord", "id", *numbers, "groups_sha256")}}

        for batch in batches:
            for ids, texts in _chunks(batch["id"], batch["text"], run_documents):
                aligned = tok.align(texts)
                if open_run.documents and (open_run.links + len(aligned["a"]) > run_links or open_run.documents + len(ids) > run_documents):
                    yield close()
                    number, open_run = number + 1, _Run(tok, radix)
                places = open_run.add(aligned)
                yield {"run": [number] * len(ids), "part": [None] * len(ids), "head": [None] * len(ids), "body": [None] * len(ids), "ord": places,
                       "id": ids, **{n: aligned[n] for n in numbers}, "groups_sha256": aligned["groups_sha256"]}
        if open_run.links:
            yield close()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"run long, part int, head array<binary>, body binary, ord int, id {kind}, {', '.join(f'{n} long' for n in numbers)}, groups_sha256 string"
    return arrow_map(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)


def _chunks(ids: list, texts: list, most: int) -> Iterator[tuple[list, list]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if i > start and (chars + len(t or "") > CHUNK_CHARS or i - start >= most):
            yield ids[start:i], texts[start:i]
            start, chars = i, 0
        chars += len(t or "")
    if start < len(ids):
        yield ids[start:], texts[start:]


def count_pairs(runs: DataFrame, low_bits: int, fan_in: int) -> DataFrame:
    """(part, counts): frames of pair, count and whether it is the highest of its second id."""

    def merge(table: pa.Table) -> pa.Table:
        merged = list(merge_runs(table["head"].to_pylist()))
        frames = _frames(*(np.concatenate(x) for x in zip(*merged)))
        return pa.table({"run": table["group"][:1], "part": table["part"][:1], "head": pa.array([frames], pa.list_(pa.binary()))})

    def last(table: pa.Table) -> pa.Table:
        frames = [f for k, t, best in with_maxima(merge_runs(table["head"].to_pylist()), low_bits) for f in _frames(k, t, best)]
        return pa.table({"part": table["part"][:1], "counts": pa.array([frames], pa.list_(pa.binary()))})

    heads, n = runs.select("run", "part", "head"), runs.select("run").distinct().count()
    while n > fan_in:
        n = -(-n // fan_in)
        grouped = heads.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(n)))
        heads = durable(grouped.groupBy("part", "group").applyInArrow(merge, "run long, part int, head array<binary>"))
    return heads.groupBy("part").applyInArrow(last, "part int, counts array<binary>")


def _contributions(runs: DataFrame, counts: DataFrame, slice_bytes: int) -> DataFrame:
    """(run, sums) of each run and radix partition: n_best and count_sum of the documents of the run.

    The bodies of a partition are cut in slices of runs by their measured bytes; each slice gets the counts of its partition.
    """
    sizes = {r.part: r.n for r in runs.groupBy("part").agg(F.sum(F.length("body")).alias("n")).collect()}
    ways = {p: max(1, -(-n // slice_bytes)) for p, n in sizes.items()}
    if not ways:
        return runs.select("run", F.col("body").alias("sums")).limit(0)
    slices = F.element_at(F.create_map(*[F.lit(x) for kv in ways.items() for x in kv]), F.col("part"))
    bodies = runs.select("part", F.pmod(F.xxhash64("run"), slices).cast("int").alias("slice"), F.col("run"), F.lit(None).cast("array<binary>").alias("counts"), "body")
    tables = counts.select("part", F.explode(F.sequence(F.lit(0), slices.cast("int") - 1)).alias("slice"), F.lit(-1).cast("long").alias("run"), "counts", F.lit(None).cast("binary").alias("body"))

    def stream(batches):
        keys = values = best = None
        for batch in batches:
            out = {"run": [], "sums": []}
            for run, frames, body in zip(batch["run"], batch["counts"], batch["body"]):
                if frames is not None:
                    read = list(_read_frames(frames, 3))
                    keys, values, best = (np.concatenate(x) for x in zip(*read))
                    continue
                pair, document, times = _unpack(body, 3)
                at = np.searchsorted(keys, np.cumsum(pair))
                n_best, count_sum = (np.zeros(int(document.max()) + 1, _INT) for _ in range(2))
                np.add.at(n_best, document, times * best[at])
                np.add.at(count_sum, document, times * values[at])
                out["run"].append(run)
                out["sums"].append(_pack(n_best, count_sum))
            yield out

    tasks = max(sum(ways.values()), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = tables.unionByName(bodies).repartition(tasks, "part", "slice").sortWithinPartitions("part", "slice", "run")
    return arrow_map(dealt.select("run", "counts", "body"), stream, "run long, sums binary")


def align(df: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", radix: int = RADIX,
          run_links: int = RUN_LINKS, run_documents: int = RUN_DOCUMENTS, fan_in: int = FAN_IN, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    ``byte_level`` is a byte-level BPE file of the `tokenizers` library (A), ``pieces`` a SentencePiece model (B); every executor has both.

    Nulls and empty texts, and texts that one side does not spell back, have zeros and an empty digest.  A null id is an id; rows that repeat
    an id or a text are rows of their own and count each time.  Ties: every pair that shares the highest count of its second id is a best
    one.  A very long text is aligned whole, in the memory of a few times its size, and is a run of its own if need be.  An empty table
    gives an empty result.  Other columns, whatever their names, are not read.
    """
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    spilled = spill(df, byte_level, pieces, id_col, text_col, radix, run_links, run_documents)
    spilled.write.parquet(folder)
    table = df.sparkSession.read.schema(spilled.schema).parquet(folder)
    runs, docs = table.filter("part IS NOT NULL").select("run", "part", "head", "body"), table.filter("part IS NULL").drop("part", "head", "body")
    low_bits = _first_bits(byte_level)
    counts = count_pairs(runs, low_bits, fan_in)
    sums = _contributions(runs, counts, slice_bytes)
    kind = df.schema[id_col].dataType.simpleString()
    numbers = ("n_a", "n_b", "n_groups", "n_links")

    def add_up(batches):
        current, n_best, count_sum = None, None, None
        for batch in batches:
            out = {n: [] for n in ("id", *numbers, "n_best", "count_sum", "groups_sha256")}
            for i, (run, blob, place) in enumerate(zip(batch["run"], batch["sums"], batch["ord"])):
                if run != current:
                    current, n_best, count_sum = run, np.zeros(run_documents + 1, _INT), np.zeros(run_documents + 1, _INT)
                if blob is not None:
                    x, y = _unpack(blob, 2)
                    n_best[: len(x)] += x
                    count_sum[: len(y)] += y
                    continue
                for n in ("id", *numbers, "groups_sha256"):
                    out[n].append(batch[n][i])
                out["n_best"].append(int(n_best[place]))
                out["count_sum"].append(int(count_sum[place]))
            yield out

    # the sums of a run come ahead of its documents
    rows = docs.withColumn("sums", F.lit(None).cast("binary")).unionByName(sums, allowMissingColumns=True)
    rows = rows.repartition("run").sortWithinPartitions("run", F.col("ord").asc_nulls_first())
    out = arrow_map(rows, add_up, f"id {kind}, {', '.join(f'{n} long' for n in (*numbers, 'n_best', 'count_sum'))}, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _first_bits(byte_level: str) -> int:
    with open(byte_level, encoding="utf-8") as f:
        return int(max(json.load(f)["model"]["vocab"].values())).bit_length()
