"""End-to-end jobs on small files."""

import json

import pytest
from pyspark.sql import functions as F

from newsflow.plans import jobs
from newsflow.schemas import DOMAIN_LABELS


def write_sites(folder, n=60):
    paths, rows = [], []
    names = list(DOMAIN_LABELS)
    for site in range(3):
        records = []
        for i in range(n):
            domain = names[(i * 7 + site) % 10] if i % 9 else "other"
            records.append({
                "date_publish": "2022-12-20", "id": "", "maintext": f"{domain} news {domain} no {i}. More about {domain} here." if i % 11 else "",
                "source_domain": domain, "url": f"u{site}-{i}", "title": f"{domain} 報告" if i % 10 == 3 else f"{domain} title {i}",
            })
        path = folder / f"z{3 - site}.json"
        path.write_text(json.dumps(records, ensure_ascii=False), encoding="utf-8")
        paths.append(str(path))
        rows += records
    return paths, rows


def test_load_numbers_in_listed_order(spark, tmp_path):
    paths, rows = write_sites(tmp_path)
    got = {r["id"]: r["url"] for r in jobs.load_articles(spark, paths).collect()}
    assert got == {i: r["url"] for i, r in enumerate(rows)}


def test_summary_job(spark, tmp_path):
    paths, rows = write_sites(tmp_path)
    counts = {r["split"]: r["n"] for r in jobs.prepare_summary_data(spark, paths, str(tmp_path / "out")).collect()}
    routed = sum("報告" in r["title"] for r in rows)
    clean = len(rows) - routed
    assert counts == {"no_title": routed, "train": int(clean * 0.8), "valid": int(clean * 0.1),
                      "test": clean - int(clean * 0.8) - int(clean * 0.1)}
    assert spark.read.json(str(tmp_path / "out" / "test")).count() == counts["test"]


def test_domain_job_and_classifier(spark, tmp_path):
    paths, rows = write_sites(tmp_path)
    counts = {r["split"]: r["n"] for r in jobs.prepare_domain_data(spark, paths, str(tmp_path / "d")).collect()}
    kept = [r for r in rows if r["maintext"] and r["source_domain"] in DOMAIN_LABELS]
    assert sum(counts.values()) == len(kept)
    schema = "id bigint, title string, sentence string, label int"
    train, valid = (spark.read.schema(schema).json(str(tmp_path / "d" / s)) for s in ("train", "valid"))
    assert sorted(r["id"] for r in valid.collect()) == list(range(counts["valid"]))
    result = jobs.run_domain_classifier(train, valid, valid, str(tmp_path / "p"), max_eval_samples=5).first()
    assert result["accuracy"] == 1.0 and result["eval_samples"] == 5
    lines = spark.read.option("header", True).csv(str(tmp_path / "p" / "predictions"))
    by_id = {r["id"]: r["source_domain"] for r in lines.collect()}
    assert by_id == {f"test-{r['id']}": r["sentence"].split()[0] for r in valid.collect()}


def test_sentiment_jobs(spark, tmp_path):
    lines = [f'{i % 2},{"good rise" if i % 2 else "bad fall"} item {i}' for i in range(100)] + ["junk", "", "7,x"]
    (tmp_path / "raw.txt").write_text("\n".join(lines), encoding="utf-8")
    counts = {r["split"]: r["n"] for r in jobs.prepare_sentiment_data(spark, str(tmp_path / "raw.txt"), str(tmp_path / "s")).collect()}
    assert counts == {"train": 90, "valid": 10}
    train = spark.read.schema("id bigint, sentence string, label string").json(str(tmp_path / "s" / "train"))
    assert all(r["sentence"] == lines[r["id"]][2:] and r["label"] == lines[r["id"]][0] for r in train.collect())
    csv = str(tmp_path / "csv")
    train.select(F.col("sentence").alias("text"), "label").write.option("header", True).csv(csv)
    for options in ({}, {"idf_on_all": True, "clean_train": True}):
        model, report = jobs.run_sentiment_baseline(spark, csv, ["item"], **options)
        assert {r["class"]: r["f1"] for r in report.collect()}["micro avg"] > 0.8
    new = spark.createDataFrame([(1, "@me good rise"), (2, "{%x%}bad fall")], "id int, text string")
    assert {r["id"]: r["pred"] for r in model.predict(new).collect()} == {1: 1, 2: 0}


def test_summary_prediction_job(spark, tmp_path):
    rows = [(1, "Rates rise today. Other words follow here.", "Rates rise"), (2, "", "Nothing"), (3, "金價上漲。市場平靜。", "金價")]
    df = spark.createDataFrame(rows, "id bigint, maintext string, title string")
    scores = jobs.summarize_articles(df, str(tmp_path / "o")).first()
    assert set(scores.asDict()) == {"rouge-1", "rouge-2", "rouge-l"} and scores["rouge-1"] > 0
    titles = spark.read.schema("title string, id bigint").json(str(tmp_path / "o" / "titles")).collect()
    assert {r["id"] for r in titles} == {1, 2, 3} and {r["id"]: r["title"] for r in titles}[2] == ""


def staged(spark):
    import os

    from newsflow.session import shared_dir

    folder = shared_dir(spark).removeprefix("file:") + "/newsflow"
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def test_jobs_leave_nothing_staged(spark, tmp_path):
    before = staged(spark)
    raw = tmp_path / "raw.txt"
    raw.write_text("".join(f"{i % 2},text number {i}\n" for i in range(40)), encoding="utf-8")
    counts = jobs.prepare_sentiment_data(spark, str(raw), str(tmp_path / "out"))
    assert staged(spark) == before
    assert sum(r[1] for r in counts.select(counts.columns[0], counts.columns[1]).collect()) == 40
    articles = spark.createDataFrame([(1, "Gold rises. Silver falls.", "Gold"), (2, None, "none")], "id bigint, maintext string, title string")
    jobs.summarize_articles(articles, str(tmp_path / "summaries")).collect()
    assert staged(spark) == before


def test_a_failed_job_leaves_nothing_staged(spark, tmp_path):
    from newsflow.session import job, stage

    before = staged(spark)

    @job
    def broken(session):
        stage(session.range(3), "a")
        assert len(staged(session)) == len(before) + 1
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        broken(spark)
    assert staged(spark) == before


def test_workers_need_no_package_on_their_path(tmp_path):
    """From another folder, the workers have only what is sent to them."""
    import os
    import subprocess
    import sys

    import newsflow

    root = os.path.dirname(os.path.dirname(os.path.abspath(newsflow.__file__)))
    code = (
        f"import importlib.util\nspec = importlib.util.spec_from_file_location('entry', r'{root}/__spark_entry__.py')\n"
        "entry = importlib.util.module_from_spec(spec)\nspec.loader.exec_module(entry)\n"
        "from pyspark.sql import SparkSession\nspark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', 2).getOrCreate()\n"
        "queries = entry.queries()\nnames = [n for n in queries if n in ('encode_tokens', 'score_sentences') or n.split('_')[0] in ('op2', 'op11', 'op13')]\n"
        "print('rows', [queries[n](spark, '/root/testdata/sf0.001').count() > 0 for n in names])"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert "rows [True" in done.stdout and "False" not in done.stdout, done.stderr[-2000:]
