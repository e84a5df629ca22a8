import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelcast.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")
WEIGHTS = (5, 2, 1)


def plain_targets(sizes):
    """Shares by weight; who would be above three times its size stays there, and the rest is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not above:
            return {s: fixed.get(s, level * weight[s]) for s in order}
        fixed.update({s: 3 * sizes[s] for s in above})


def place(doc_id, text):
    of_text = "" if text is None else hashlib.md5(text.encode()).hexdigest()
    return hashlib.md5(f"{'' if doc_id is None else doc_id}\n{of_text}".encode()).hexdigest()


def plain_mix(rows):
    sized = [(r[0], r[3], len(WORD.findall(r[1] or "")), r[1]) for r in rows]
    sums = Counter()
    for _, source, size, _ in sized:
        sums[source] += size
    out, targets = [], plain_targets(sums)
    for source in sums:
        own = sorted((r for r in sized if r[1] == source),
                     key=lambda r: (place(r[0], r[3]), r[0] or 0, r[2]))
        goal, before = math.floor(targets[source] + 0.5), 0
        for doc_id, _, size, _ in own:
            passes = goal // sums[source] if sums[source] else 0
            taken = passes * size + max(0, min(goal - passes * sums[source] - before, size))
            out.append((doc_id, size, sums[source], round(targets[source], 6), taken))
            before += size
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.size_, r.source_size, round(r.target, 6), r.taken)
                   for r in df.withColumnRenamed("size", "size_").collect())


def test_query_equals_brute_force(docs, clashing):
    want = plain_mix([tuple(r) for r in docs.collect()])
    assert got(mixing.query(docs)) == want
    assert got(mixing.query(clashing)) == want


def test_null_ids_are_spread_by_their_texts(spark):
    rows = [(None, f"text {i} of many", "en", "src0", 0) for i in range(2000)] + [(7, f"other {i}", "en", None, 0) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert got(mixing.query(docs)) == plain_mix(rows)
    places = docs.groupBy(mixing.order_of().substr(1, 3)).count().agg(F.max("count")).first()[0]
    assert places < 20
    mixed = mixing.mix(mixing.with_sizes(docs).withColumn("_order", F.lit("own")))
    assert {r._order for r in mixed.collect()} == {"own"} and got(mixed) == plain_mix(rows)


def test_targets_are_met_and_positions_are_sorted(docs):
    rows = mixing.query(docs).collect()
    by_target = Counter()
    for r in rows:
        by_target[r.target, r.source_size] += r.taken
        assert r.taken <= 3 * r["size"]
    assert all(abs(taken - target) <= 1 for (target, _), taken in by_target.items())
    positions = [r.position for r in rows if r.position is not None]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    assert all((r.position is None) == (r.taken == 0) for r in rows)


def test_reruns_agree(docs):
    assert mixing.query(docs).collect() == mixing.query(docs.repartition(5)).collect()


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 1_000_000}, {"a": 7}, {"a": 0, "b": 9}, {"a": 0},
    {"x": 100, None: 3, "b": 50, "Z": 2},
])
def test_water_level(spark, sizes):
    sums = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size bigint")
    rows = mixing.targets(sums.withColumn("_source", mixing.source_key())).collect()
    want = plain_targets(sizes)
    assert {r._source: round(r.target, 6) for r in rows} == {
        f"={s}" if s is not None else "": round(t, 6) for s, t in want.items()}


def test_position_inverts_the_integral_of_the_weight(spark):
    rows = [(w0, 2 - w0, offset, 100.0) for w0 in (0.5, 0.9, 1.0, 1.5, 2.0) for offset in (0, 1, 37, 99, 100)]
    df = spark.createDataFrame(rows, "w0 double, w1 double, offset int, total double")
    for r in df.withColumn("t", mixing.due(F.col("offset"), F.col("total"), F.col("w0"), F.col("w1"))).collect():
        demand = r.total * (r.w0 * r.t + (r.w1 - r.w0) * r.t**2 / 2) / ((r.w0 + r.w1) / 2)
        assert demand == pytest.approx(r.offset, abs=1e-6) and 0 <= r.t <= 1 + 1e-12


def test_stream_has_each_pass_in_order(docs, clashing, empty):
    assert mixing.query(empty).collect() == [] == mixing.training_stream(empty).collect()
    assert mixing.query(empty.union(empty.sparkSession.createDataFrame([(1, "", None, None, 0)], empty.schema))).first().taken == 0
    rows = mixing.training_stream(clashing).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    per_doc, passes = Counter(), Counter()
    for r in rows:
        assert 0 < r.taken <= r["size"] and {r.score, r._order, r._bucket, r._before, r._start, r._w0, r._w1, r._passes} == {"own"}
        per_doc[r.doc_id, r.text] += r.taken
        passes[r.doc_id, r.source, r.text] += 1
    want = Counter()
    for r in mixing.query(docs).collect():
        want[r.doc_id] += r.taken
    assert Counter({k: v for k, v in want.items() if v}) == sum(
        (Counter({i: n}) for (i, _), n in per_doc.items()), Counter())
    assert max(passes.values()) <= 9  # three passes of a row that is there three times
