import datetime
import json

import pytest

from matchloom.sources import files, paged, pages, ragged


def test_application_page(spark):
    page = {"created_time": "2024-01-02T00:00:00Z", "properties": {"Company": {"title": [{"plain_text": "A"}, {"text": {"content": "B"}}]}, "Job title": {"rich_text": [{"plain_text": "Dev"}]}, "Status": {"status": {"name": "Applied"}}, "Job source": {"select": {"name": "S"}}, "Application date": {"date": {"start": "2024-01-02T10:00"}}, "Referral": {"checkbox": True}}}
    rows = pages.applications(spark.createDataFrame([(json.dumps(page),), ("{}",), ("broken",)], "json string")).collect()
    assert (rows[0].company, rows[0].job_title, rows[0].status, rows[0].job_source, rows[0].application_date, rows[0].referral) == ("AB", "Dev", "Applied", "S", "2024-01-02", True)
    assert rows[1].company == rows[2].company == "" and not rows[1].referral


def test_score_page(spark):
    text = lambda s: {"rich_text": [{"plain_text": s}]}
    page = {"properties": {"Score": {"number": 80}, "Matched terms": text('["b","a"]'), "Category breakdown": text("not json"), "Fit label": text("")}}
    r = pages.scores(spark.createDataFrame([(json.dumps(page),)], "json string")).first()
    assert r.score == 80 and r.matched_terms == ["b", "a"] and r.category_breakdown == {} and r.fit_label is None


def test_update_and_score_errors(spark):
    rows = spark.createDataFrame([(" A ", "t", "u", "s", "2024-01-02", "Applied", ""), ("", "t", "u", "s", "2024-1-2", "Odd", None)], "company string, job_title string, job_url string, job_source string, application_date string, status string, job_description string")
    good, bad = pages.update_errors(rows).collect()
    assert good.errors == [] and good.company == "A" and len(bad.errors) == 3
    kind = "application_key string, input_fingerprint string, scorer_version string, embedding_model string, score double, band string, matched_terms array<string>, category_breakdown map<string,double>"
    rows = spark.createDataFrame([("k", "f", "v", "m", 80.0, "Strong", [" b", "B", "a", "", "a"], {"x": 1.0}), ("", "f", "v", "m", 80.0, "Weak", None, {"x": 1.0, " x": 2.0}), ("k", "f", "v", "m", 101.0, "Strong", [], {"y": 200.0})], kind)
    a, b, c = pages.score_errors(rows).collect()
    assert a.errors == [] and a.matched_terms == ["a", "B", "b"]
    assert len(b.errors) == 4 and len(c.errors) == 2


def test_event_lines(spark):
    lines = [(1, 1, "event: go"), (1, 2, "data: 1"), (1, 3, "event: complete"), (1, 4, "data: [2]"), (1, 5, "data: 3"), (2, 1, "event: error"), (2, 2, "data: no"), (3, 1, "data: x")]
    got = {r.stream: (r.outcome, r.data) for r in files.completed(spark.createDataFrame(lines, "stream int, pos int, line string")).collect()}
    assert got == {1: ("complete", "[2]"), 2: ("error", "no"), 3: ("unfinished", None)}


def test_catalog_and_supplied(spark, tmp_path):
    for family, name in (("one-column", "b"), ("two", "a")):
        (tmp_path / family / "pdf").mkdir(parents=True)
        (tmp_path / family / "pdf" / f"{name}.pdf").write_bytes(b"abc")
    (tmp_path / "two" / "c.pdf").write_bytes(b"not in a pdf folder")
    rows = files.catalog(spark, str(tmp_path), content=True).collect()
    assert {(r.version, r.label) for r in rows} == {("one-column/b", "One Column | b"), ("two/a", "Two | a")}
    assert {r.content_sha256 for r in rows} == {"ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}
    (tmp_path / "d.json").write_text(json.dumps({"k1": {"job_description": "x"}, "k2": {"provenance": "p"}}))
    assert {(r.application_key, r.job_description, r.provenance) for r in files.supplied(spark, str(tmp_path / "d.json")).collect()} == {("k1", "x", None), ("k2", None, "p")}


def test_offsets(spark):
    index = files.offsets(spark.createDataFrame([("a", 2), ("b", 3), ("c", 2)], "document_hash string, token_count long"))
    assert {(r.document_hash, r.offset) for r in index.collect()} == {("b", 0), ("a", 3), ("c", 5)}
    assert tuple(files.offset_errors(index, 7).first()) == (0, 0, 0, 0)
    assert tuple(files.offset_errors(spark.createDataFrame([("a", 0, 2), ("a", 3, 0), ("b", 4, 9)], "document_hash string, offset long, token_count long"), 7).first()) == (1, 1, 2, 1)


def test_extracted_text(spark):
    rows = spark.createDataFrame([(b" a \n\n b",), (b"c",)], "content binary")
    assert sorted(r.text for r in files.extracted(rows, lambda data: data.decode()).collect()) == ["a\nb", "c"]
    with pytest.raises(Exception, match="the file has no text"):
        files.extracted(spark.createDataFrame([(b" \n",)], "content binary"), lambda data: data.decode()).collect()


def test_events_longer_than_a_mebibyte(spark):
    long = "x" * (1_100_000)
    got = files.completed(spark.createDataFrame([(1, 1, "event: complete"), (1, 2, "data: " + long)], "stream int, pos int, line string")).first()
    assert got.data == long


def test_paged_source(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    options = {"client": "matchloom.sources.paged:FolderClient", "folder": str(tmp_path), "page_size": "2"}
    client = paged.FolderClient(options)
    for i in range(7):
        client.upsert({"id": i, "shard": f"s{i % 2}", "status": "Applied" if i % 3 else "Rejected"})
    load = lambda **more: spark.read.format("paged").options(**options, **more).load()
    read = lambda **more: sorted(int(r.id) for r in load(**more).collect())
    assert read() == list(range(7)) and read(filter="Rejected") == [0, 3, 6]
    new = spark.createDataFrame([(json.dumps({"id": i, "shard": "s1", "status": "Applied"}),) for i in (6, 7)], "json string")
    for _ in range(2):
        new.write.format("paged").options(**options).mode("append").save()
    assert read() == [0, 1, 2, 3, 4, 5, 6, 6, 7]
    gone = spark.createDataFrame([(json.dumps({"id": 6}), "trash"), (json.dumps({"id": 1, "shard": "s1", "status": "New"}), None)], "json string, action string")
    gone.write.format("paged").options(**options, schema_patch='{"Status": "status", "Old": null}').mode("append").save()
    assert read() == [0, 1, 2, 3, 4, 5, 7] and read(filter="New") == [1]
    client.patch_schema({"Score": "number", "Status": None})
    assert json.loads((tmp_path / "schema.json").read_text()) == {"Score": "number"}
    with pytest.raises(Exception, match="upserted or trashed"):
        gone.selectExpr("json", "'burn' AS action").write.format("paged").options(**options).mode("append").save()


def test_ranges():
    day = datetime.date
    wanted = paged.Range()
    for f in (paged.GreaterThan(("application_date",), day(2024, 1, 3)), paged.LessThanOrEqual(("application_date",), day(2024, 2, 1)), paged.LessThan(("application_date",), day(2024, 3, 1)), paged.EqualTo(("id",), "x"), paged.EqualTo(("status",), "Applied")):
        wanted = wanted.narrowed(f)
    assert wanted == paged.Range(day(2024, 1, 4), day(2024, 2, 1), "Applied")
    page = {"application_date": "2024-01-04", "status": "Applied", "edited": 5}
    assert wanted.has(page) and not wanted.has(page | {"status": "New"}) and not wanted.has(page | {"application_date": None}) and not wanted.has(page | {"application_date": "2024-01-03"})
    assert paged.Range(since=4, until=5).has(page) and not paged.Range(since=5).has(page) and not paged.Range(until=4).has(page)


class Asked(paged.FolderClient):
    """Writes down what it was asked for."""

    def query(self, shard, wanted, cursor):
        with open(f"{self.root}/asked.txt", "a") as f:
            f.write(f"{wanted.first} {wanted.last} {wanted.status}\n")
        return super().query(shard, wanted, cursor)


def test_date_ranges_are_pushed(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    options = {"client": "tests.test_sources:Asked", "folder": str(tmp_path), "page_size": "3"}
    for i in range(20):
        Asked(options).upsert({"id": i, "shard": f"s{i % 2}", "status": "Applied" if i % 2 else "New", "application_date": f"2024-01-{i + 1:02d}"})
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key, "false")
    try:
        spark.conf.set(key, "true")
        rows = spark.read.format("paged").options(**options).load().where("application_date BETWEEN DATE'2024-01-05' AND DATE'2024-01-09' AND status = 'Applied'")
        assert sorted(int(r.id) for r in rows.collect()) == [5, 7]
    finally:
        spark.conf.set(key, before)
    assert set((tmp_path / "asked.txt").read_text().splitlines()) == {"2024-01-05 2024-01-09 Applied"}


def test_stream_of_changes_goes_on_from_its_checkpoint(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    options = {"client": "matchloom.sources.paged:FolderClient", "folder": str(tmp_path / "store"), "page_size": "2"}
    client = paged.FolderClient(options)
    for i in range(5):
        client.upsert({"id": i, "shard": f"s{i % 2}"})

    def run():
        out = spark.readStream.format("paged").options(**options).load().select("id", "edited").writeStream.format("parquet")
        out.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["0", "1", "2", "3", "4"]
    client.upsert({"id": 3, "shard": "s1"})
    client.upsert({"id": 9, "shard": "s2"})
    assert run() == ["0", "1", "2", "3", "3", "4", "9"] == run()


def store_rows(spark, n=40):
    sizes = [(i * 7) % 11 + 1 for i in range(n)] + [70]
    rows = [(f"{i:02x}{'0' * 62}", p, [float(i), p / 4, -1.5]) for i, size in enumerate(sizes) for p in range(size)]
    return spark.createDataFrame(rows, "document_hash string, pos long, vec array<float>"), rows


@pytest.mark.parametrize("kind", ["<f2", "<f4"])
def test_ragged_store(spark, tmp_path, kind):
    tokens, rows = store_rows(spark)
    index = ragged.write_store(tokens.repartition(7), str(tmp_path), 3, kind, block_rows=16)
    assert index.agg({"token_count": "sum"}).first()[0] == len(rows)
    ragged.checked(index, len(rows))
    read = lambda some: sorted((r.document_hash, r.pos, r.vec) for r in ragged.fetch(str(tmp_path), some, 3, kind, block_rows=16).collect())
    assert read(index) == sorted(rows)
    assert read(index.where("document_hash < '03'")) == sorted(r for r in rows if r[0] < "03")
    assert read(index.limit(0)) == []
    assert all(len(r.data) == r.n_rows * 3 * int(kind[-1]) and r.n_rows <= 16 for r in spark.read.parquet(f"{tmp_path}/blocks").collect())


def test_ragged_store_refuses_damage(spark, tmp_path):
    tokens, rows = store_rows(spark)
    good = str(tmp_path / "good")
    index = ragged.write_store(tokens, good, 3, "<f4", block_rows=16)
    for name, bad in (("gap", index.where("document_hash > '05'")), ("twice", index.unionAll(index.limit(1))), ("moved", index.selectExpr("document_hash", "offset + 1 AS offset", "token_count"))):
        with pytest.raises(ValueError, match="doesn't fit"):
            ragged.checked(bad, len(rows) if name != "moved" else len(rows))
    blocks = spark.read.parquet(f"{good}/blocks")
    damages = {
        "missing or there twice": blocks.where("block <> 3"),
        "cut short": blocks.selectExpr("block", "first", "n_rows", "CASE WHEN block = 2 THEN substring(data, 1, 20) ELSE data END AS data"),
        "ends before": blocks.selectExpr("block", "first", "CASE WHEN block = 1 THEN n_rows - 1 ELSE n_rows END AS n_rows", "CASE WHEN block = 1 THEN substring(data, 1, 180) ELSE data END AS data"),
    }
    for i, (message, damaged) in enumerate(damages.items()):
        damaged.write.parquet(str(tmp_path / f"bad{i}" / "blocks"))
        with pytest.raises(Exception, match=message):
            ragged.fetch(str(tmp_path / f"bad{i}"), index, 3, "<f4", block_rows=16).collect()
    for i, (message, wrong) in enumerate({"missing or given twice": tokens.unionAll(tokens.limit(1)), "outside": tokens.withColumn("pos", tokens.pos + 1), "another length": tokens.selectExpr("document_hash", "pos", "slice(vec, 1, 2) AS vec")}.items()):
        with pytest.raises(Exception, match=f"{message}|outside|missing"):
            ragged.write_store(wrong, str(tmp_path / f"wrong{i}"), 3, block_rows=16)
