"""Round trips of sources, sinks, the cache and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from newsflow.operators.cleaning import clean_for_domain
from newsflow.schemas import ARTICLE, LABELLED_TEXT
from newsflow.session import shared_dir, stage
from newsflow.sources import json_arrays, readers, writers
from newsflow.streaming.ingest import stream_ingest_articles

RECORDS = [
    {"date_publish": "2022-12-20", "id": "", "maintext": "一\n二", "source_domain": "gold", "url": "u1", "title": "t1", "extra": 1},
    {"date_publish": "2022-12-21", "id": "", "maintext": "", "source_domain": "gold", "url": "u2"},
]


def test_json_arrays(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"site{i}.json").write_text(json.dumps(RECORDS, indent=4, ensure_ascii=False), encoding="utf-8")
    df = readers.scan_json_array(spark, str(tmp_path))
    assert df.count() == 4 and df.columns == ARTICLE.fieldNames()
    assert df.filter(F.col("title").isNull()).count() == 2
    assert df.filter("maintext = '一\n二'").count() == 2


ODD_VALUES = [
    "plain", 'a "quoted" word', "brace } in { text", "}{][\\\"", "back\\slash\\", '\\"}', "", "é日本👍", "line\nbreak\ttab", ", {", '"},{"a": "', "x" * 90, "[1, 2]", "\u2028",
]


def odd_records(n=60):
    return [{"n": i, "a": ODD_VALUES[i % len(ODD_VALUES)], "b": [{"c": ODD_VALUES[(i * 5 + 1) % len(ODD_VALUES)]}] * (i % 3)} for i in range(n)]


@pytest.fixture
def splits_of(spark):
    """Set the size of a split; back to the default afterwards."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    yield lambda n: [spark.conf.set(k, str(n)) for k in keys]
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


@pytest.mark.parametrize("split", [83, 1 << 20])
def test_json_arrays_of_any_split(spark, tmp_path, splits_of, split):
    """Every layout gives the records in file order, wherever the splits fall."""
    schema = "n long, a string, b array<struct<c:string>>"
    records = odd_records(17)
    layouts = {
        "compact.json": json.dumps(records, ensure_ascii=False), "escaped.json": json.dumps(records, indent=4), "spaced.json": "\ufeff \n" + json.dumps(records, indent=1, ensure_ascii=False) + "\n\n",
        "mixed.json": json.dumps([x for r in records for x in (r, 5, "no } {", None, True)]), "lines.json": "\n".join(json.dumps(r) for r in records), "one.json": json.dumps(records[7], indent=2),
        "empty.json": "[]", "nothing.json": "",
    }
    for name, text in layouts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    splits_of(split)
    got = json_arrays.scan_json_array(spark, str(tmp_path), spark.createDataFrame([], schema).schema, positions=True)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["_file"], r["_block"], r["_row"])):
        found.setdefault(r["_file"].rsplit("/", 1)[1], []).append({"n": r["n"], "a": r["a"], "b": [{"c": x["c"]} for x in r["b"]]})
    assert sorted(found) == ["compact.json", "escaped.json", "lines.json", "mixed.json", "one.json", "spaced.json"]
    for name, rows in found.items():
        assert rows == (records[7:8] if name == "one.json" else records), name


def test_json_array_round_trip(spark, tmp_path, splits_of):
    rows = [(r["n"], r["a"], None if r["n"] % 4 else "x") for r in odd_records(60)]
    df = spark.createDataFrame(rows, "n long, a string, c string").repartition(5, "n")
    json_arrays.write_json_array(df, str(tmp_path / "out"))
    files = [json.loads(f.read_text(encoding="utf-8")) for f in (tmp_path / "out").glob("part-*")]
    assert sorted((r["n"], r["a"], r["c"]) for f in files for r in f) == sorted(rows, key=lambda r: r[0])
    splits_of(400)
    assert sorted(tuple(r) for r in json_arrays.scan_json_array(spark, str(tmp_path / "out"), df.schema).collect()) == sorted(rows, key=lambda r: r[0])


def test_a_broken_record_gives_nulls(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"n": 1}, {"n": oops}, {"n": "text"}, {}, {"n": 4}]')
    schema = spark.createDataFrame([], "n long").schema
    got = [r["n"] for r in json_arrays.scan_json_array(spark, str(tmp_path), schema).collect()]
    assert sorted(got, key=lambda n: n or 0) == [None, None, None, 1, 4]


def test_csv_quotes_and_breaks(spark, tmp_path):
    texts = ['plain', 'a "quoted" word', "two\nlines, comma", " padded ", '"']
    df = spark.createDataFrame([("1", t) for t in texts], LABELLED_TEXT)
    writers.write_labelled_csv(df, str(tmp_path / "out"))
    assert sorted(r["text"] for r in readers.scan_csv_labelled(spark, str(tmp_path / "out")).collect()) == sorted(texts)


def test_labelled_lines(spark, tmp_path):
    path = tmp_path / "raw.txt"
    path.write_text('1,good\n0,"quoted\n2,bad label\n\n1\n0,a,b\nx1,no\n', encoding="utf-8")
    got = [(r["label"], r["text"]) for r in readers.scan_labelled_lines(spark, str(path)).collect()]
    assert got == [("1", "good"), ("0", '"quoted"'), ("0", "a,b")]


def test_splits_need_known_extension(spark, tmp_path):
    with pytest.raises(ValueError, match="should be one of"):
        readers.load_splits(spark, {"train": str(tmp_path / "x.txt")}, ARTICLE)


def test_stopwords_and_label_map(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("若果\n 的 \n\n若果\n软\n", encoding="utf-8")
    words = {r["word"] for r in readers.load_stopwords(spark, str(tmp_path / "stop.txt"), "软", "軟").collect()}
    assert words == {"若果", "的", "軟"}
    (tmp_path / "map.json").write_text('{\n  "負面": 0,\n  "正面": 1\n}', encoding="utf-8")
    got = {r["label_text"]: r["label_id"] for r in readers.load_label_map(spark, str(tmp_path / "map.json")).collect()}
    assert got == {"負面": 0, "正面": 1}


def test_cache(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    assert writers.read_through_cache(spark, path, build).count() == 1
    assert writers.read_through_cache(spark, path, build).count() == 1
    assert writers.read_through_cache(spark, path, build, overwrite=True).count() == 2


def test_predictions_are_paired_by_id(spark, tmp_path):
    refs = spark.createDataFrame([(i, f"r{i}") for i in range(20)], "id bigint, references string")
    preds = spark.createDataFrame([(i, f"p{i}") for i in reversed(range(20))], "id bigint, predictions string")
    writers.write_eval_predictions(preds, refs, str(tmp_path / "p"))
    back = spark.read.option("header", True).csv(str(tmp_path / "p")).collect()
    assert len(back) == 20 and all(r["predictions"][1:] == r["references"][1:] == r["id"] for r in back)


def test_metrics_file(spark, tmp_path):
    writers.write_metrics(spark.createDataFrame([(0.5, 3)], "accuracy double, samples int"), str(tmp_path / "m"), "eval_")
    files = list((tmp_path / "m").glob("*.json"))
    assert len(files) == 1 and json.loads(files[0].read_text()) == {"eval_accuracy": 0.5, "eval_samples": 3}
    writers.write_metrics(spark.range(7), str(tmp_path / "many"))
    assert spark.read.json(str(tmp_path / "many")).count() == 7


def test_category_folders_split_hot_category(spark, tmp_path):
    df = spark.range(1000).withColumn("source_domain", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold"))
    writers.write_by_category(df, str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "c").glob("source_domain=*")) == ["source_domain=cold", "source_domain=hot"]
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1000


def test_stream_equals_batch_and_is_incremental(spark, tmp_path):
    drops, sink, check = (str(tmp_path / d) for d in ("drops", "sink", "check"))
    rows = [("", str(i), "x" if i % 4 else "", "gold" if i % 3 else "other", "u", "t") for i in range(40)]
    first, second = spark.createDataFrame(rows[:25], ARTICLE), spark.createDataFrame(rows[25:], ARTICLE)
    writers.write_json_records(first.repartition(3), drops)
    stream_ingest_articles(spark, drops, sink, check)
    writers.write_json_records(second, drops, mode="append")
    stream_ingest_articles(spark, drops, sink, check)
    stream_ingest_articles(spark, drops, sink, check)
    got = sorted(r["id"] for r in spark.read.schema(ARTICLE).parquet(sink).collect())
    assert got == sorted(r["id"] for r in clean_for_domain(first.union(second)).collect())


def test_staging_uses_shared_folder(spark):
    staged = stage(spark.range(3), "numbers")
    assert all(shared_dir(spark) in f for f in staged.inputFiles())
