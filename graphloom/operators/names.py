"""Names of a dictionary in texts, by an Aho-Corasick automaton.

Every text is read once. What is broadcast is a stated number of bytes: a
small dictionary as it is; of a larger one the heads of its names, as long as
fit, with the lengths of the names behind each. The pieces of texts that a head
and a length point at are looked up in the dictionary by a join.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_valid_entity, strip_legal_suffix
from ..session import materialise

#: Bytes of names or heads that are broadcast; their automaton takes some fifty times as much.
BLOCK_BYTES = 1 << 20
#: Letters of a head, the longest that fit are taken.
HEADS = (64, 48, 32, 24, 20, 16, 14, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
#: Letters of a name without its legal suffix at least.
MIN_CORE = 4

#: The automaton that this worker used last, and of which block.
_last: tuple[str, object] | None = None


def patterns(names: DataFrame, min_core: int = MIN_CORE) -> DataFrame:
    """(pattern, full, names): what to look for, in lower case, and the names that it stands for in order.

    Whole names, and names without their legal suffix. Null, short and generic
    names (``is_valid_entity``) are left out.
    """
    n = names.select("name").filter(is_valid_entity(F.col("name"))).distinct()
    n = n.select("name", F.lower("name").alias("full"), F.lower(strip_legal_suffix(F.col("name"))).alias("core"))
    both = n.select(F.col("full").alias("pattern"), F.lit(True).alias("full"), "name").union(n.filter(F.length("core") >= min_core).select("core", F.lit(False), "name"))
    return both.filter("pattern <> ''").groupBy("pattern", "full").agg(F.array_sort(F.collect_set("name")).alias("names"))


def _automaton(block: Broadcast):
    """Of each pattern the automaton holds its number; built once a worker for a block (key, rows)."""
    import ahocorasick

    global _last
    key, rows = block.value
    if _last is None or _last[0] != key:
        a = ahocorasick.Automaton()
        by_pattern: dict[str, list[int]] = {}
        for i, (pattern, _, _) in enumerate(rows):
            by_pattern.setdefault(pattern, []).append(i)
        for pattern, own in by_pattern.items():
            a.add_word(pattern, own)
        if by_pattern:
            a.make_automaton()
        _last = key, a
    return _last[1]


def _edge(text: str, i: int) -> bool:
    """Whether a word begins or ends at i."""
    word = lambda c: c.isalnum() or c == "_"
    return (i > 0 and word(text[i - 1])) != (i < len(text) and word(text[i]))


def places(text: str, block: Broadcast) -> list[tuple[str, bool, list[str], list[int]]]:
    """(pattern, full, names, starts) of a block's patterns in a text: of whole names the first place, of others all that stand between word edges."""
    automaton, rows, found = _automaton(block), block.value[1], {}
    if not len(automaton):
        return []
    for last, own in automaton.iter(text):
        for i in own:
            pattern, full, _ = rows[i]
            start = last + 1 - len(pattern)
            if full:
                found.setdefault(i, [start])
            elif _edge(text, start) and _edge(text, last + 1):
                found.setdefault(i, []).append(start)
    return [(*rows[i], starts) for i, starts in found.items()]


def choose(hits: list[tuple[str, bool, list[str], list[int]]]) -> list[tuple[str, int]]:
    """(name, step): whole names first, the longest first, on characters that no other has taken; then names without their suffix."""
    taken: set[int] = set()
    out: list[tuple[str, int]] = []
    for pattern, _, names, starts in sorted((h for h in hits if h[1]), key=lambda h: (-len(h[0]), h[2][0])):
        span = range(starts[0], starts[0] + len(pattern))
        if taken.isdisjoint(span):
            out.append((names[0], 1))  # others of the same letters find their place taken
            taken.update(span)
    found = {n for n, _ in out}
    for pattern, _, names, starts in sorted((h for h in hits if not h[1]), key=lambda h: (-len(h[0]), h[0])):
        behind = 0
        for start in sorted(starts):
            if start < behind:  # places of one pattern don't overlap
                continue
            span = range(start, behind := start + len(pattern))
            if taken.isdisjoint(span):
                out += [(n, 2) for n in names if n not in found]
                found.update(names)
                taken.update(span)
                break
    return out


def heads(dictionary: DataFrame, most_bytes: int = BLOCK_BYTES) -> list[tuple[str, list[int]]]:
    """(head, lengths of the patterns that begin so), with the longest heads whose rows take ``most_bytes`` at most, one letter at least.

    Heads of n letters are no more than those of n + 1, so the longest that fit are found by halving.
    """
    d = dictionary.select("pattern", F.length("pattern").alias("n"))
    low, high = 0, len(HEADS) - 1
    while low < high:
        at = (low + high) // 2
        cut = d.select(F.substring("pattern", 1, HEADS[at]).alias("head"), "n").distinct()
        if (cut.agg(F.sum(F.octet_length("head") + 64)).first()[0] or 0) <= most_bytes:
            high = at
        else:
            low = at + 1
    rows = d.groupBy(F.substring("pattern", 1, HEADS[low]).alias("head")).agg(F.sort_array(F.collect_set("n")).alias("sizes"))
    return sorted((r.head, list(r.sizes)) for r in rows.collect())


def pieces(text: str, block: Broadcast) -> list[tuple[str, int, list[int]]]:
    """(piece, first place, places between word edges) of a text that a head and a length of its patterns point at."""
    import ahocorasick

    global _last
    key, rows = block.value
    if _last is None or _last[0] != key:
        a = ahocorasick.Automaton()
        for head, sizes in rows:
            a.add_word(head, (len(head), sizes))
        a.make_automaton()
        _last = key, a
    found: dict[str, tuple[int, list[int]]] = {}
    for last, (own, sizes) in _last[1].iter(text):
        start = last + 1 - own
        for n in sizes:
            if start + n <= len(text):
                edged = found.setdefault(text[start : start + n], (start, []))[1]
                if _edge(text, start) and _edge(text, start + n):
                    edged.append(start)
    return [(piece, first, edged) for piece, (first, edged) in found.items()]


def nested(lists: pa.ListArray) -> list[list]:
    """The lists of a column without nulls, its values converted at once."""
    values, ends = lists.flatten().to_pylist(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return [values[a:b] for a, b in itertools.pairwise(ends.tolist())]


def _rows(ids: pa.Array, chosen: list[list[tuple[str, int]]]) -> pa.RecordBatch:
    at = pa.array([i for i, own in enumerate(chosen) for _ in own], pa.int64())
    flat = [x for own in chosen for x in own]
    return pa.RecordBatch.from_arrays([ids.take(at), pa.array([n for n, _ in flat], pa.string()), pa.array([s for _, s in flat], pa.int32())], names=["qid", "name", "step"])


def match_entities(queries: DataFrame, names: DataFrame, min_core: int = MIN_CORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(qid, name, step) of the names (name) that the texts (qid, q) hold, in no order.

    A name counts where its text first stands, without regard to case, longest
    first, on characters that no other has taken (step 1); then names without
    their legal suffix, between word edges (step 2). Of names that are equal but for
    case the first counts. Every row of ``queries`` is matched by itself, also where ids repeat
    or are null. Null and empty texts hold no names; an empty dictionary
    matches nothing.
    """
    spark = queries.sparkSession
    kind = queries.schema["qid"].dataType.simpleString()
    d = materialise(patterns(names, min_core), "patterns")
    size = F.octet_length("pattern") + F.aggregate("names", F.lit(0), lambda a, n: a + F.octet_length(n)) + 64
    total = d.agg(F.sum(size)).first()[0] or 0
    q = queries.select("qid", F.lower("q").alias("q")).filter("q <> ''")
    if not total:
        return q.select("qid", F.lit("").alias("name"), F.lit(0).alias("step")).filter("false")
    if total <= block_bytes:
        block = spark.sparkContext.broadcast((uuid.uuid4().hex, sorted(tuple(r) for r in d.collect())))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _rows(batch.column(0), [choose(places(t, block)) for t in batch.column(1).to_pylist()])

        return q.mapInArrow(whole, f"qid {kind}, name string, step int")
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, heads(d, block_bytes)))

    def pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 1000) for a in range(0, batch.num_rows, 1000)):
                at, flat = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    own = pieces(text, shared)
                    at += [i] * len(own)
                    flat += own
                at = pa.array(at, pa.int64())
                columns = [pa.array([x[k] for x in flat], t) for k, t in ((0, pa.string()), (1, pa.int32()), (2, pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), *columns], names=["qid", "row", "pattern", "first", "edged"])

    found = q.withColumn("row", F.monotonically_increasing_id()).mapInArrow(pointed, f"qid {kind}, row long, pattern string, first int, edged array<int>")
    # written, since numbers of rows must not change between tries
    found = materialise(found, "pieces").join(d, "pattern").filter("full or size(edged) > 0")
    hit = F.struct("pattern", "full", "names", F.when(F.col("full"), F.array("first")).otherwise(F.col("edged")).alias("starts"))
    gathered = found.groupBy("row").agg(F.first("qid").alias("qid"), F.collect_list(hit).alias("hits"))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(1)
            one, ends = [nested(c) if pa.types.is_list(c.type) else c.to_pylist() for c in hits.flatten().flatten()], hits.offsets.to_numpy() - hits.offsets[0].as_py()
            every = list(zip(*one, strict=True))
            yield _rows(batch.column(0), [choose(every[a:b]) for a, b in itertools.pairwise(ends.tolist())])

    return gathered.select("qid", "hits").mapInArrow(picked, f"qid {kind}, name string, step int")
