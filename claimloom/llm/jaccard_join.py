"""Exact n-gram Jaccard join by blocked sparse products.

A document is the set of its word n-grams; two documents link when the sets are similar enough.  Equal sets are one class.

1. A slice of the n-gram space (SLICE of all hashes) is dealt out by n-gram.  A class can only link when nearly all of its
   n-grams in the slice occur in another class too: the bound follows from its size.  Nearly all classes end here.
2. For the rest, the slice is dealt out again and gives the number of classes per n-gram.  In the order (slice first, rare
   n-grams first) two linked classes share one of their first n - need + 1 n-grams, ``need`` being the smallest overlap
   that a link allows.  Classes that share one are connected; the connected parts are independent of each other.
3. Each part is a product of its document by n-gram matrix with itself, row by row, accumulating overlap counts and leaving out
   documents that sizes rule out or that are already linked.  Large parts are cut in blocks, every pair of blocks is
   a task, and a task returns at most one link per document: copies are never expanded to all pairs.

N-grams are 64-bit hashes of word hashes, classes 64-bit hashes of their sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import bloom
from claimloom.llm.common import arrow_map, kept_by_worker, lower_ascii, words_of
from claimloom.llm.graph import components
from claimloom.operators.joins import shuffled
from claimloom.session import durable

SLICE = 0.375
_SLICE_END = int(SLICE * 2**32)
# Documents of one block of a large part, and n-grams that one task of many small parts takes.
BLOCK_DOCS = 2_000
TASK_NGRAMS = 1_000_000
CACHE_WORDS = 300_000


@dataclass(frozen=True)
class Rule:
    """n-grams of ``words`` words; a link needs an overlap of at least ``percent`` of the union."""

    words: int = 5
    percent: int = 80

    def need(self, n: np.ndarray) -> np.ndarray:
        """Smallest overlap of any link of a set of ``n``."""
        return -(-n * self.percent // 100)

    def linked(self, overlap: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
        return 100 * overlap >= self.percent * (n + m - overlap)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def ngrams(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer words is one n-gram, a text without words has none."""
    tokens = words_of(lower_ascii(text)) if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    known = kept_by_worker("jaccard", _Words)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = _mixed(total + h[k : len(h) - width + 1 + k])
    return np.unique(total)


def _class(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - 2**63 if len(grams) else 0


def _high(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(32)).astype(np.int64)


def _keys(grams: np.ndarray) -> np.ndarray:
    """n-grams as signed numbers."""
    return grams.view(np.int64)


def _documents(batches, words: int):
    """Distinct n-gram sets of each batch: lists of classes and of sets."""
    for b in batches:
        sets: dict[int, np.ndarray] = {}
        for text in b["text"]:
            g = ngrams(text, words)
            if len(g):
                sets.setdefault(_class(g), g)
        yield sets


def _dealt(sets: dict[int, np.ndarray], parts: int) -> dict:
    """The slice of a batch cut in ``parts`` by n-gram: one row per part with its classes, counts and 32-bit remainders."""
    ids = np.array(list(sets), np.int64)
    low = [g[: np.searchsorted(_high(g), _SLICE_END)] for g in sets.values()]
    grams = np.concatenate(low) if low else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(low)), [len(g) for g in low])
    part = _high(grams) * parts // _SLICE_END
    order = np.lexsort((owner, part))
    grams, owner, part = grams[order], owner[order], part[order]
    out = {"part": [], "ids": [], "counts": [], "rests": []}
    for p, a, b in zip(*_runs(part)):
        mine, counts = np.unique(owner[a:b], return_counts=True)
        out["part"].append(int(p))
        out["ids"].append(ids[mine].tobytes())
        out["counts"].append(counts.astype("<u4").tobytes())
        out["rests"].append((grams[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
    return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and ends of the runs of a sorted array."""
    if not len(x):
        return x, np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return x[starts], starts, np.r_[starts[1:], len(x)]


_DEALT = "part int, ids binary, counts binary, rests binary"


def _joined(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, owner of each n-gram and remainders of one part; a class that several batches sent counts once."""
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in rows["ids"]])
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in rows["counts"]]).astype(np.int64)
    rests = np.concatenate([np.frombuffer(x, "<u4") for x in rows["rests"]])
    classes, first, code = np.unique(ids, return_index=True, return_inverse=True)
    once = np.zeros(len(ids), bool)
    once[first] = True
    take = np.repeat(once, counts)
    return classes, np.repeat(code, counts)[take], rests[take]


def _class_counts(rests: np.ndarray) -> np.ndarray:
    """For each remainder, how many classes have it (remainders are distinct within a class)."""
    _, code, counts = np.unique(rests, return_inverse=True, return_counts=True)
    return counts[code]


def _shared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    classes, owner, rests = _joined(rows)
    shared = np.bincount(owner[_class_counts(rests) > 1], minlength=len(classes))
    some = shared > 0
    return pd.DataFrame({"cid": classes[some], "shared": shared[some]})


def _frequencies(blocks: int):
    """Of one part: the n-grams that several classes have, with the number of classes, dealt out by class."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        classes, owner, rests = _joined(rows)
        many = _class_counts(rests)
        some = many > 1
        owner, many, keys = owner[some], many[some], rests[some].astype(np.int64) + (int(key[0]) << 32)
        block = (classes % blocks)[owner]
        order = np.argsort(block, kind="stable")
        owner, many, keys = owner[order], many[order], keys[order]
        out = {"block": [], "ids": [], "keys": [], "many": []}
        for b, start, end in zip(*_runs(block[order])):
            out["block"].append(int(b))
            out["ids"].append(classes[owner[start:end]].tobytes())
            out["keys"].append(keys[start:end].tobytes())
            out["many"].append(many[start:end].astype(np.int64).tobytes())
        return pd.DataFrame(out)

    return run


def _prefixes(rule: Rule):
    """Of one block of classes: the first n-grams of each in the order rare first that more than one class has."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows[rows["keys"].isna()]
        rows = rows[rows["keys"].notna()]
        ids, n, low = (np.concatenate([np.frombuffer(x, np.int64) for x in sizes[c]] or [np.zeros(0, np.int64)]) for c in ("ids", "many", "low"))
        of = pd.Series(np.arange(len(ids)), index=ids)
        cid, keys, many = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[c]] or [np.zeros(0, np.int64)]) for c in ("ids", "keys", "many"))
        known = np.isin(cid, ids)
        cid, keys, many = cid[known], keys[known], many[known]
        who = of.reindex(cid).to_numpy().astype(np.int64)
        order = np.lexsort((keys, many, who))
        who, keys = who[order], keys[order]
        _, start, end = _runs(who)
        rank = np.arange(len(who)) - np.repeat(start, end - start)
        repeated = np.bincount(who, minlength=len(ids))
        # n-grams that only this class has come first and take up room, but cannot match
        room = n - rule.need(n) + 1 - (low - repeated)
        take = rank < room[who]
        return pd.DataFrame({"key": keys[take], "cid": ids[who[take]]})

    return run


def forest(sets: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Links that connect what is linked: a row of the product at a time, against documents not reached yet."""
    n = np.array([len(s) for s in sets], np.int64)
    waiting = np.ones(len(sets), bool)
    owner = np.repeat(np.arange(len(sets)), n)
    grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    indexed, links = len(sets), []
    for first in range(len(sets)):
        if not waiting[first]:
            continue
        waiting[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            left = int(waiting.sum())
            if not left:
                return links
            if left < indexed // 2:
                keep = waiting[owner]
                grams, owner, indexed = grams[keep], owner[keep], left
            lo, hi = np.searchsorted(grams, sets[x], "left"), np.searchsorted(grams, sets[x], "right")
            many = hi - lo
            at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
            overlap = np.bincount(owner[at], minlength=len(sets))
            near = np.flatnonzero((overlap >= rule.need(n[x])) & waiting)
            near = near[rule.linked(overlap[near], n[x], n[near])]
            waiting[near] = False
            links.extend((x, int(y)) for y in near)
            queue.extend(near.tolist())
    return links


def _verify(rule: Rule):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in rows.groupby("comp", sort=False):
            part = part.sort_values("n", ascending=False)
            ids = part["cid"].to_numpy()
            found += [(ids[a], ids[b]) for a, b in forest([np.frombuffer(x, np.uint64) for x in part["grams"]], rule)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(), block_docs: int = BLOCK_DOCS,
         parts: int | None = None) -> DataFrame:
    """id, n_shingles, component_id of every row: the smallest id that links reach, the row's own included.

    A null or empty text, and a text of blanks, has no n-grams and links with nothing.  Repeated rows and texts of equal sets
    are one class.  A null id takes part in links but is never a component's id unless no other is there.  Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))

    def measure(batches):
        for b in batches:
            sets = [ngrams(t, rule.words) for t in b["text"]]
            yield {
                "id": b["id"], "th": b["th"], "n": [len(g) for g in sets], "cid": [_class(g) for g in sets],
                "low": [int(np.searchsorted(_high(g), _SLICE_END)) for g in sets],
            }

    rows = durable(arrow_map(texts, measure, f"id {kind}, th long, n long, cid long, low long"))
    classes = rows.filter("n > 0").groupBy("cid").agg(F.min("id").alias("least"), F.max("n").alias("n"), F.max("low").alias("low"), F.min("th").alias("th"))
    dealt = arrow_map(texts.select("text"), lambda bs: (_dealt(s, parts) for s in _documents(bs, rule.words)), _DEALT)
    shared = dealt.groupBy("part").applyInPandas(_shared, "cid long, shared long").groupBy("cid").agg(F.sum("shared").alias("shared"))
    slack = F.col("n") - F.ceil(F.col("n") * rule.percent / 100)
    possible = durable(classes.join(shuffled(shared), "cid", "left").filter(F.col("low") - F.coalesce("shared", F.lit(0)) <= slack).select("cid", "n", "low", "th"))

    # the sets of the possible classes: a filter of bounded size finds their texts in the scan, the join makes it exact
    bits = bloom.repeated(possible, "th", least=1)
    near = bloom.maybe_repeated(texts.select("th", "text"), "th", bits, "maybe").filter("maybe").select("text")

    def collect_sets(batches):
        for sets in _documents(batches, rule.words):
            yield {"cid": list(sets), "grams": [g.tobytes() for g in sets.values()]}

    found = arrow_map(near, collect_sets, "cid long, grams binary").dropDuplicates(["cid"])
    sets = durable(found.join(shuffled(possible.select("cid", "n", "low")), "cid"))

    # classes that share a rare n-gram
    def deal_sets(batches):
        for b in batches:
            yield _dealt({c: np.frombuffer(g, np.uint64) for c, g in zip(b["cid"], b["grams"])}, parts)

    def sizes(batches):
        for b in batches:
            cid, n, low = (np.array(b[c], np.int64) for c in ("cid", "n", "low"))
            block = cid % parts
            each = [(int(k), block == k) for k in np.unique(block)]
            yield {"block": [k for k, _ in each], "ids": [cid[m].tobytes() for _, m in each], "keys": [None] * len(each),
                   "many": [n[m].tobytes() for _, m in each], "low": [low[m].tobytes() for _, m in each]}

    wide = "block int, ids binary, keys binary, many binary"
    counted = arrow_map(sets.select("cid", "grams"), deal_sets, _DEALT).groupBy("part").applyInPandas(_frequencies(parts), wide)
    counted = counted.withColumn("low", F.lit(None).cast("binary")).unionByName(arrow_map(sets.select("cid", "n", "low"), sizes, wide + ", low binary"))
    first = counted.groupBy("block").applyInPandas(_prefixes(rule), "key long, cid long")

    def beyond_slice(batches):
        """Short sets whose first n-grams are not all in the slice: all of the slice, then the others by hash."""
        for b in batches:
            out = {"key": [], "cid": []}
            for cid, n, low, grams in zip(b["cid"], b["n"], b["low"], b["grams"]):
                room = n - int(rule.need(n)) + 1
                if room > low:
                    g = np.frombuffer(grams, np.uint64)[:room]
                    part = np.minimum(_high(g) * parts // _SLICE_END, 2**30)
                    keys = np.where(np.arange(room) < low, (g & np.uint64(0xFFFFFFFF)).astype(np.int64) + (part << 32), -1 - np.abs(_keys(g)))
                    out["key"] += keys.tolist()
                    out["cid"] += [cid] * room
            yield out

    postings = durable(first.unionByName(arrow_map(sets, beyond_slice, "key long, cid long")))
    heads = postings.groupBy("key").agg(F.min("cid").alias("a"), F.count("*").alias("k")).filter("k > 1").select("key", "a")
    touching = postings.join(shuffled(heads), "key").select("a", F.col("cid").alias("b")).filter("a <> b").distinct()
    comps = components(touching).select(F.col("node").alias("cid"), F.col("component").alias("comp"))

    # products of the connected parts
    totals = comps.join(shuffled(sets.select("cid", "n")), "cid").groupBy("comp").agg(F.count("*").alias("docs"), F.sum("n").alias("grams_in"))
    blocks = totals.select("comp", F.ceil(F.greatest(F.col("docs") / block_docs, F.col("grams_in") / (4 * TASK_NGRAMS))).cast("int").alias("ways"))
    mass = totals.agg(F.sum("grams_in")).first()[0] or 0
    tasks = max(1, int(mass // TASK_NGRAMS))
    placed = sets.select("cid", "n", "grams").join(shuffled(comps), "cid").join(shuffled(blocks), "comp")
    mine = F.pmod(F.xxhash64("cid"), F.col("ways")).cast("int")
    other = F.explode(F.when(F.col("ways") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("ways") - 1), lambda k: k != F.col("mine"))))
    placed = placed.withColumn("mine", mine).select("*", other.alias("other"))
    task = F.when(F.col("ways") == 1, F.struct(F.pmod(F.xxhash64("comp"), F.lit(tasks)).alias("k"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))).otherwise(
        F.struct(F.col("comp").alias("k"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    )
    links = placed.select(task.alias("task"), "comp", "cid", "n", "grams").groupBy("task").applyInPandas(_verify(rule), "a long, b long")

    linked = components(links).select(F.col("node").alias("cid"), F.col("component").alias("comp"))
    grouped = durable(classes.select("cid", "least").join(shuffled(linked), "cid", "left").select("cid", "least", F.coalesce("comp", "cid").alias("comp")))
    roots = grouped.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_class = grouped.join(shuffled(roots), "comp").select("cid", "component_id")
    some = rows.filter("n > 0").join(shuffled(by_class), "cid").select("id", "n", "component_id")
    empty = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return some.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """One document of each group, the one whose id is the component's, with all columns.

    Rows of a null id stay.  Of several rows of one id all stay if one does.
    """
    linked = durable(link(docs, id_col, text_col, rule))
    stays = F.max(F.col(id_col) == F.col("component_id"))
    return bloom.without(docs, linked.groupBy(id_col).agg(stays.alias("stays")).filter("not stays").select(id_col), id_col)
