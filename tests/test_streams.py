import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import known_keys, state
from leadloom.operators.dedup import common_subsequence, pair_rarity
from leadloom.sources import versions
from leadloom.streaming import flows

from .test_operators import sequential

LEADS = "id long, email string, domain_normalized string, company_name string"


def random_leads(seed, count):
    rng = random.Random(seed)
    words = ["acme", "acmee", "labs", "lab", "studio", "north", "nort", "x", "solutions", "berlin"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) + rng.choice(["", "", "s", "q"])
    return [(i + 1, rng.choice(["", f"u{rng.randint(0, 60)}@x.io"]), rng.choice(["", f"d{rng.randint(0, 80)}.io"]), name()) for i in range(count)]


def test_batches_are_decided_as_one_table(spark, tmp_path):
    rows = random_leads(90, 150)
    cuts = [0, 3, 60, 100, 150]
    got = []
    for number, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        for _ in range(2 if number == 2 else 1):  # one is run again
            found = known_keys.resolve_batch(spark.createDataFrame(rows[low:high], LEADS), str(tmp_path / "known"), number).collect()
        got += [tuple(r) for r in found]
    assert sorted(got) == sequential(rows, 90)
    assert [f.rsplit("/", 1)[1] for f in versions.folders(spark, str(tmp_path / "known" / "keys"))] == ["base=2", "batch=2", "batch=3"]


@pytest.mark.parametrize("threshold", [90, 75, 55, 30])
def test_the_index_loses_no_similar_name(spark, threshold):
    names = sorted({" ".join(sorted(r[3].split())) for r in random_leads(threshold, 140)} - {""} | {"x", "xq", "q", "qx"})
    table = lambda some: spark.createDataFrame([(n, i) for i, n in enumerate(some)], "name_key string, orig long")
    rarity = pair_rarity(table(names[:9]))  # most pairs of letters are unknown to it
    near = known_keys._near(known_keys._meetings(table(names[::2]).select("name_key"), rarity, threshold, False), known_keys._meetings(table(names[1::2]), rarity, threshold, True), threshold)
    alike = lambda a, b: 200 * common_subsequence(a, b) >= threshold * (len(a) + len(b))
    want = {b for b in names[1::2] if any(alike(a, b) for a in names[::2])}
    assert want and want <= {r.name_key for r in near.collect()}


def test_a_late_first_batch_and_an_empty_one(spark, tmp_path):
    first = spark.createDataFrame([(7, "", "", "Bright Labs Berlin")], LEADS)
    later = spark.createDataFrame([(9, "", "", "Bright Labs Berlyn"), (10, None, None, None)], LEADS)
    at = str(tmp_path / "known")
    assert [tuple(r) for r in known_keys.resolve_batch(first, at, 3).collect()] == [(7, 0, None, None)]
    assert known_keys.resolve_batch(first.limit(0), at, 5).collect() == []
    assert sorted(tuple(r) for r in known_keys.resolve_batch(later, at, 6).collect()) == [(9, 1, 7, "fuzzy_company_name"), (10, 0, None, None)]


def test_a_batch_meets_few_stored_names(spark, tmp_path):
    """Of 3,000 names that end alike, a batch reads only those that may be similar."""
    rng = random.Random(5)
    rows = [(i, "", "", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) + " solutions") for i in range(3000)]
    known_keys.resolve_batch(spark.createDataFrame(rows, LEADS), str(tmp_path / "known"), 0)
    index = versions.read(spark, str(tmp_path / "known" / "names"), known_keys.NAMES)
    rarity = spark.read.parquet(str(tmp_path / "known" / "rarity" / "batch=0"))
    name = spark.createDataFrame([(rows[17][3][:-1],)], "name_key string")
    mine = known_keys._meetings(name, rarity, 90, False)
    assert index.join(mine.select("meet"), "meet", "left_semi").select("name_key").distinct().count() < 600
    assert known_keys._near(mine, index, 90).where(F.col("orig") == 17).count() == 1


def test_versions(spark, tmp_path):
    at = str(tmp_path / "v")
    total = lambda rows: rows.agg(F.sum("n").alias("n"))
    assert versions.read(spark, at, "n long").count() == 0 and versions.folders(spark, at) == []
    for number in range(70):
        versions.compact(spark, at, "n long", number, total)
        versions.write(spark.range(number, number + 1).select(F.col("id").alias("n")).coalesce(1), at, number)
        assert len(versions.folders(spark, at)) <= versions.EVERY + 1
    assert total(versions.read(spark, at, "n long")).first()[0] == sum(range(70))
    assert total(versions.read(spark, at, "n long", 66)).first()[0] == sum(range(66))
    assert versions.numbers(spark, at, "base") == [32, 64]


def test_counts_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    at = str(tmp_path / "ev")
    event = lambda low, high, minute: spark.range(low, high).selectExpr("id % 3 AS session_id", "id AS seq", "id AS lead_id", "if(id % 2 = 0, 'done', 'scoring') AS step", "'SCORED' AS status", "cast(null AS string) AS error", f"timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, {minute}, id) AS ts")
    files = [event(0, 40, 0), event(30, 60, 0), event(60, 70, 600), event(0, 75, 0), event(75, 90, 30)]  # replays, and late ones
    for rows in files:
        rows.coalesce(1).write.mode("append").parquet(at)
        flows.follow_counts(flows.progress_stream(spark, at), str(tmp_path / "counts"), str(tmp_path / "cp")).awaitTermination()
    every = files[0]
    for rows in files[1:]:
        every = every.unionByName(rows)
    want = state.progress_counts(every.dropDuplicates(["session_id", "seq"]).where("seq < 60 OR seq >= 70").unionByName(files[2]))
    got = flows.current_counts(spark, str(tmp_path / "counts"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
