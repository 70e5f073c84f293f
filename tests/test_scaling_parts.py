"""Loaders and sources, CSV records, splits, joins and training against plain versions, in small parts."""

import csv
import io
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from spectrafdr.operators import calibrator as C
from spectrafdr.operators import features as E
from spectrafdr.operators import joins, proteome, scale, split
from spectrafdr.sources import arrow_blocks, csv_records, loaders, saved


class Counting(io.BytesIO):
    """A file that counts what is read from it."""

    def __init__(self, data):
        super().__init__(data)
        self.total, self.bytes = len(data), 0

    def size(self):
        return self.total

    def read(self, n=-1):
        out = super().read(n)
        self.bytes += len(out)
        return out


@pytest.mark.parametrize("sizes", [[], [0], [5], [3, 0, 4000, 1], [20_000] * 7])
def test_batches_are_counted_without_their_bodies(sizes):
    schema = pa.schema([("a", pa.int64()), ("b", pa.list_(pa.float64())), ("c", pa.string())])
    sink = io.BytesIO()
    with pa.ipc.new_file(sink, schema) as out:
        for n in sizes:
            out.write_batch(pa.record_batch([list(range(n)), [[0.5] * 3] * n, ["text"] * n], schema=schema))
    file = Counting(sink.getvalue())
    found = arrow_blocks.blocks(file)
    assert [b.rows for b in found] == sizes
    assert [b.start for b in found] == [sum(sizes[:i]) for i in range(len(sizes))]
    assert file.bytes < 4000 + 1000 * len(sizes)
    with pytest.raises(ValueError, match="not an Arrow"):
        arrow_blocks.blocks(Counting(b"plain text, no file of that kind"))


def test_ipc_source_numbers_rows_and_joins_schemas(spark, tmp_path):
    for name, columns in (("a", {"x": [1, 2, 3], "y": ["p", "q", "r"]}), ("b", {"x": [4], "z": [0.5]})):
        table = pa.table(columns)
        with pa.ipc.new_file(str(tmp_path / f"{name}.ipc"), table.schema) as out:
            for batch in table.to_batches(max_chunksize=1):
                out.write_batch(batch)
    loaders.register_sources(spark)
    read = spark.read.format("psm-ipc").option("splitRows", 2).load(str(tmp_path))
    rows = sorted((r.file[-5:], r.row_number, r.x, r.y, r.z) for r in read.collect())
    assert rows == [("a.ipc", 0, 1, "p", None), ("a.ipc", 1, 2, "q", None), ("a.ipc", 2, 3, "r", None), ("b.ipc", 0, 4, None, 0.5)]
    assert read.rdd.getNumPartitions() == 3


@pytest.mark.parametrize("split_bytes", [1, 7, 40, 10_000])
def test_mztab_source_reads_every_line_once(spark, tmp_path, split_bytes):
    lines = ["MTD\tx\ty", "PSH\tsequence\tscore", *[f"PSM\tAB{i}C\t{'null' if i % 3 == 0 else i}" for i in range(9)], "COM\tPSM\tz", "PSM\tlast"]
    path = tmp_path / "run.mztab"
    path.write_bytes("\n".join(lines).encode())
    loaders.register_sources(spark)
    read = spark.read.format("psm-mztab").option("splitBytes", split_bytes).load(str(path))
    want = [(f"AB{i}C", None if i % 3 == 0 else str(i)) for i in range(9)] + [("last", None)]
    assert sorted((r.sequence, r.score or "") for r in read.collect()) == sorted((a, b or "") for a, b in want)


def test_loaders_are_found_by_name(spark):
    @loaders.loader("test only")
    def load(spark, data_path, predictions_path=None, value=1):
        return spark.createDataFrame([(["A"], True, value)], "prediction array<string>, valid_prediction boolean, v int")

    try:
        assert loaders.load_psms(spark, "test only", "x", value=3).first().v == 3
        with pytest.raises(KeyError, match="already"):
            loaders.loader("test only")(load)
        loaders.LOADERS["test only"] = lambda spark, data_path, predictions_path: spark.range(1)
        with pytest.raises(ValueError, match="missing column"):
            loaders.load_psms(spark, "test only", "x")
    finally:
        del loaders.LOADERS["test only"]
    with pytest.raises(KeyError, match="no loader"):
        loaders.load_psms(spark, "test only", "x")


@pytest.mark.parametrize("split_bytes", [16, 100, 1_000_000])
def test_csv_records_over_many_lines(spark, tmp_path, split_bytes):
    rng = random.Random(split_bytes)
    cells = ['plain', 'two\nlines', 'a "quoted" word', '"\n"\n"', 'x,y', "\n\n\n", "ends with \n", "007", "'"]
    folder = tmp_path / "t.csv"
    folder.mkdir()
    want = []
    for part in range(3):
        rows = [[f"{part}-{i}", *rng.choices(cells, k=2)] for i in range(25)]
        want += rows
        with open(folder / f"part-{part}.csv", "w", newline="") as file:
            out = csv.writer(file, lineterminator="\n")
            out.writerows([["id", "first", "second"], *rows])
    found = csv_records.read_csv(spark, str(folder), split_bytes)
    assert found.columns == ["id", "first", "second"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want))


def test_csv_without_breaks_uses_the_splittable_reader(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x,y"\n2,\n')
    found = csv_records.read_csv(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in found.collect()] == [("1", "x,y"), ("2", None)]


def test_numbers_keep_all_their_digits(spark):
    rows = [("12345678901234567", "007", "1.5", "12345678901234567890", "true", "-3", "0"), ("2", "7", "2", "1", "FALSE", "4", None)]
    df = saved.typed_cells(spark.createDataFrame(rows, [f"c{i}" for i in range(7)]), skip=())
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "string", "double", "string", "boolean", "bigint", "bigint"]
    assert tuple(df.first()) == (12345678901234567, "007", 1.5, "12345678901234567890", True, -3, 0)


@pytest.mark.parametrize("bucket", [2_000_000, 3])
def test_groups_stay_whole(spark, monkeypatch, bucket):
    monkeypatch.setattr(scale, "ROWS_PER_BUCKET", bucket)
    rng = random.Random(4)
    names = [None, "big", *[f"g{i}" for i in range(9)]]
    rows = [(i, rng.choice(names) if i % 3 else "big") for i in range(400)]
    df = spark.createDataFrame(rows, "i int, g string").repartition(5)
    train, val = split.group_split(df, "g", 0.3, seed=2)
    sides = [{r.g for r in x.select("g").distinct().collect()} for x in (train, val)]
    assert not sides[0] & sides[1] and sides[0] | sides[1] == set(names)
    assert train.count() + val.count() == 400
    largest = max(sum(1 for r in rows if r[1] == g) for g in names)
    assert 0.3 * 400 <= val.count() < 0.3 * 400 + largest
    again = split.group_split(df.repartition(2), "g", 0.3, seed=2)[1]
    assert sorted(r.i for r in again.collect()) == sorted(r.i for r in val.collect())
    alone, none = split.group_split(spark.createDataFrame([(1, "x"), (2, "x")], "i int, g string"), "g", 0.5)
    assert alone.count() == 2 and none.count() == 0


def test_names_of_rows_do_not_depend_on_partitions(spark):
    rows = [(i % 7, float(i % 3)) for i in range(50)] + [(1, 1.0)] * 30
    df = spark.createDataFrame(rows, "a int, b double")
    one, other = (split.named_rows(df.repartition(n), "_id") for n in (1, 6))
    assert one.select("_id").distinct().count() == 80
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


@pytest.mark.parametrize("unit, tolerance", [("da", 0.5), ("da", 0.1), ("ppm", 20.0), ("ppm", 50_000.0)])
@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_band_join_matches_all_pairs(spark, monkeypatch, unit, tolerance, hot):
    monkeypatch.setattr(scale, "HOT_KEY_ROWS", hot)
    rng = random.Random(1)
    nan = float("nan")
    left = [(i % 3, round(rng.uniform(0, 10), 1)) for i in range(80)] + [(0, None), (1, nan), (1, 5.0), (1, 5.0)] + [(2, 5.0)] * 20
    right = [(i % 3, round(rng.uniform(0, 10), 1)) for i in range(60)] + [(0, None), (2, nan), (1, 5.0), (0, -1.0), (0, 0.0)] + [(2, 5.0)] * 15

    def near(a, b):
        if a is None or b is None or math.isnan(a) or math.isnan(b) or unit == "ppm" and min(a, b) <= 0:
            return False
        return abs(a - b) <= (tolerance if unit == "da" else b * tolerance / 1e6)

    want = sorted((k, a, b) for k, a in left for j, b in right if k == j and near(a, b))
    frames = (spark.createDataFrame(x, f"k int, {n} double") for x, n in ((left, "a"), (right, "b")))
    found = joins.band_join(*frames, ["k"], "a", "b", tolerance, unit)
    assert sorted((r.k, r.a, r.b) for r in found.collect()) == want


def test_band_join_needs_a_tolerance(spark):
    with pytest.raises(ValueError, match="positive tolerance"):
        joins.band_join(spark.range(1), spark.range(1), [], "id", "id", 0.0)


@pytest.mark.parametrize("bucket", [2_000_000, 6])
def test_candidates_of_a_hot_key_come_in_chunks(spark, monkeypatch, bucket):
    monkeypatch.setattr(scale, "ROWS_PER_BUCKET", bucket)
    rows = [("hot" if i % 3 else f"k{i % 5}", (i * 37) % 101, i) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, s int, i int")
    found = joins.candidate_chunks(df, "k", ["s", "i"], ["i"], "c", size=10).collect()
    assert max(len(r.c) for r in found) <= 10
    for key in {r[0] for r in rows}:
        own = [x.i for r in sorted(found, key=lambda r: r.chunk) if r.k == key for x in r.c]
        assert own == [i for _, i in sorted((s, i) for k, s, i in rows if k == key)]
    best = joins.top_k_per_key(df, "k", [F.asc("s"), F.asc("i")], 2).collect()
    assert max(r["rank"] for r in best) == 2 and len(best) == 2 * len({r[0] for r in rows})


def training_frame(spark, n, tasks):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 2))
    y = rng.random(n) < 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1]))
    rows = [(float(a), float(b), float(c), bool(d)) for (a, b), c, d in zip(x, rng.random(n), y)]
    rows += [(0.5, 0.5, 0.5, True)] * (n // 2)  # a repeated row
    return spark.createDataFrame(rows, "f double, g double, confidence double, correct boolean").repartition(tasks)


def test_synchronous_training_does_not_depend_on_tasks(spark):
    fitted = []
    for tasks in (4, 64):
        model = C.ProbabilityCalibrator(["f", "g"], hidden_dims=(8, 4), dropout=0.2, max_epochs=5, steps_per_epoch=3, synchronous=True,
                                        learning_rate=0.05)
        history = model.fit(training_frame(spark, 600, tasks))
        assert history.train_losses[-1] < history.train_losses[0]
        fitted.append(model.weights)
    for one, other in zip(*fitted):
        assert np.allclose(one, other, atol=1e-9)


def test_shards_follow_from_rows_and_spread_copies(spark, monkeypatch):
    monkeypatch.setattr(C, "ROWS_PER_SHARD", 50)
    model = C.ProbabilityCalibrator(["f", "g"], hidden_dims=(4,), max_epochs=1)
    model.fit(training_frame(spark, 400, 3))
    assert model.shards == 12
    matrix = C.feature_matrix(training_frame(spark, 400, 3), ["f", "g"], "correct")
    counts = model._spread(matrix).withColumn("p", F.spark_partition_id()).groupBy("p").agg(
        F.count("*").alias("n"), F.count_if(F.expr("f = 0.5 AND g = 0.5")).alias("copies")
    ).collect()
    assert sum(r.n for r in counts) == 600
    assert {r.copies for r in counts} <= {16, 17} and len(counts) == 12


def test_counters_come_with_the_features(spark):
    df = spark.createDataFrame([(i, i % 4 == 0) for i in range(20)], "i int, is_missing_x boolean")
    counters = Observation("test")
    out = E.count_missing(df, counters)
    assert out.count() == 20
    assert counters.get == {"n_rows": 20, "n_is_missing_x": 5}


def test_shared_steps_run_once_while_named(spark):
    calls = []
    step = E.Dependency("step", lambda df: calls.append(1) or df.withColumn("s", F.lit(2)))
    one, two = (E.CustomFeature(n, [n], lambda df, n=n: df.withColumn(n, F.col("s") + 1), (step,)) for n in "ab")
    features = E.FeatureSet(one, two)
    assert features(spark.range(1)).first().asDict() == {"id": 0, "s": 2, "a": 3, "b": 3} and calls == [1]
    features.remove("a")
    assert features.dependency_names == ["step"]
    features.remove("b")
    assert features.dependency_names == []


def test_seed_filter_lets_every_seed_through(spark, monkeypatch):
    rng = random.Random(6)
    seeds = sorted({"".join(rng.choices("ACDEFGHIKL", k=7)) for _ in range(300)})
    frame = spark.createDataFrame([(s,) for s in seeds], "seed string")
    asked = frame.withColumn("known", F.lit(True)).union(
        spark.createDataFrame([("".join(rng.choices("MNPQRSTVWY", k=7)), False) for _ in range(2000)], "seed string, known boolean")
    )
    passed = asked.withColumn("p", proteome._may_be_in(frame)).groupBy("known").agg(F.avg(F.col("p").cast("int")).alias("share"))
    shares = {r.known: r.share for r in passed.collect()}
    assert shares[True] == 1.0 and shares[False] < 0.1
    monkeypatch.setattr(proteome, "FILTER_BYTES", 1)  # too small a filter only lets more through
    assert asked.filter(proteome._may_be_in(frame)).filter("known").count() == len(seeds)


def test_few_positions_of_a_protein_become_rows(spark, monkeypatch):
    monkeypatch.setattr(proteome, "CHUNK_LENGTH", 1000)
    rng = random.Random(8)
    hay = "".join(rng.choices("ACDEFGHKLMNPQRSTVWY", k=60_000))
    odd = "é" * 70 + hay[:80] + "ß√" + hay[80:200]
    proteins = spark.createDataFrame([(hay,), (odd,), (None,), ("",)], "sequence string").coalesce(1)
    peptides = [hay[i : i + 9] for i in range(995, 50_000, 1000)] + ["éAC" + hay[2:8], hay[75:80] + "ß√", hay[50_000:50_100], hay[-6:] + "é"]
    held, n_bits = proteome._seed_filter(spark.createDataFrame([(p[:7],) for p in peptides], "seed string"), len(peptides))
    asked = proteome._named(proteins).mapInArrow(proteome._survivors(held, n_bits, [7]), "id long, start long, window string")
    rows = asked.collect()
    whole = {spark.range(1).select(F.xxhash64(F.lit(t))).first()[0]: t for t in (hay, odd)}
    assert all(r.window == whole[r.id][r.start - 1 : r.start + 63] for r in rows)
    assert len(rows) < 1000  # of 60,272 places
    found = proteome.found_peptides(spark.createDataFrame([(p,) for p in peptides], "peptide string"), proteins)
    assert {r[0] for r in found.collect()} == {p for p in peptides if p in hay or p in odd}


def test_tokens_of_plain_peptides_follow_the_grammar(spark):
    from spectrafdr.constants import TOKEN_PATTERN
    from spectrafdr.functions import peptides as P

    texts = ["PEPTIDE", "A", "", "pEp", "M(ox)K", "AC\n", "A C", "[Acetyl]-MK", "ÄB", "K+1.5", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select(P.tokenise(F.col("t")).alias("got"), F.regexp_extract_all("t", F.lit(TOKEN_PATTERN), F.lit(0)).alias("want"))
    assert all(r.got == r.want for r in got.collect())


def test_token_lists_are_computed_once(spark):
    from spectrafdr.functions import peptides as P

    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(n):
        calls.add(1)
        return ["A"] * n if n >= 0 else None

    rows = spark.range(-1, 3).select(P.clean_tokens(tokens("id")).alias("t")).collect()
    assert [r.t for r in rows] == [None, None, ["A"], ["A", "A"]] and calls.value == 4
    text = P.clean_tokens(F.transform(F.array("id"), lambda v: v.cast("string")))
    assert spark.range(1).select(text.alias("t"))._jdf.queryExecution().optimizedPlan().toString().count("cast(") == 1


def test_csv_query_moves_no_fixed_share_of_the_documents(spark, tmp_path, monkeypatch):
    from spectrafdr.workload import value_queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(12, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(value_queries, "_folder", lambda s: str(tmp_path / "out"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")  # a file a task
    try:
        assert value_queries.saved_csv_types(spark, str(tmp_path)).count() == docs.count()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert len(list((tmp_path / "out" / "typed.csv").glob("part-*"))) == 12


def test_prediction_job_stores_no_beams(spark, monkeypatch):
    from spectrafdr.workload import QUERIES

    stored, store = [], scale.store
    monkeypatch.setattr(scale, "store", lambda df: stored.append(df.columns) or store(df))
    assert QUERIES["predict_job_values"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(stored) == 2 and not any("beams" in columns for columns in stored)


@pytest.mark.parametrize("broken", ["", "two\nlines"])
def test_empty_csv_cells_with_and_without_quotes(spark, tmp_path, broken):
    text = f'id,first,second\n1,"",x\n2,,""\n3,"a\rb","{broken}\r"\n4,"c\r\nd"\n' if broken else 'id,first,second\n1,"",x\n2,,""\n4,y\n'
    (tmp_path / "t.csv").write_bytes(text.encode())
    found = {r.id: tuple(r)[1:] for r in csv_records.read_csv(spark, str(tmp_path / "t.csv")).collect()}
    want = {"1": ("", "x"), "2": (None, ""), "4": ("y", None)}
    assert found == (want | {"3": ("a\rb", "two\nlines\r"), "4": ("c\r\nd", None)} if broken else want)


def test_quoted_carriage_returns_end_no_csv_record(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'id,t\r\n1,"a\rb"\r\n2,c\r\n')
    assert csv_records.read_csv(spark, str(tmp_path / "t.csv")).collect() == [("1", "a\rb"), ("2", "c")]
    (tmp_path / "old.csv").write_bytes(b'id,t\r1,"x,y"\r2,c\r')  # all line ends are carriage returns
    assert csv_records.read_csv(spark, str(tmp_path / "old.csv")).collect() == [("1", "x,y"), ("2", "c")]


def test_long_numbers_and_empty_texts_are_typed(spark):
    rows = [("9223372036854775807", "9223372036854775808", "", "true", ""), ("-9223372036854775808", "1", "1.5", "", "")]
    df = saved.typed_cells(spark.createDataFrame(rows, [f"c{i}" for i in range(5)]), skip=())
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "string", "double", "boolean", "string"]
    assert tuple(df.first()) == (2**63 - 1, "9223372036854775808", None, True, "")


@pytest.mark.parametrize(
    "texts",
    [
        ["", None, '"', "a\nb", "a\rb", "\r\n", "ends\r", " lead", "tail ", "\\", "null", "NaN", 'x\n"y",\n'],
        ["", None, "a\rb", "plain"],  # no line break
        ["1", "02", "3.50"],
        ["true", "FALSE"],
    ],
)
@pytest.mark.parametrize("first", [0, 1 << 40, 9_000_000_000_000])
def test_csv_query_on_odd_documents(spark, tmp_path, texts, first):
    import oracle

    from spectrafdr.workload import ORACLES, QUERIES

    rows = [(first + i, t, len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").toPandas()
    docs.to_parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["saved_csv_types"](spark, str(tmp_path))
    assert oracle.difference(df, oracle.connect(str(tmp_path)), ORACLES["saved_csv_types"]) is None
