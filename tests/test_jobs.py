"""Benchmarks, downloads, parsing, images, bundles and the jobs over them, on small files."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom import jobs
from assayloom.operators import article as R
from assayloom.operators import images as I
from assayloom.operators import retrieval
from assayloom.sources import benchmark, downloads, readers, writers


def png(image: np.ndarray) -> bytes:
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    color = {2: 0, 3: 2}[image.ndim]
    raw = b"".join(b"\0" + row.tobytes() for row in image)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, color, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def micrograph() -> np.ndarray:
    """Dark discs of radius 12 on light grey, and a dark bar 100 pixels long."""
    image = np.full((240, 320), 200, np.uint8)
    y, x = np.mgrid[:240, :320]
    for cy, cx in ((50, 60), (60, 160), (110, 250), (130, 90)):
        image[(y - cy) ** 2 + (x - cx) ** 2 <= 144] = 60
    image[215:220, 200:300] = 20
    return image


def test_scale_bar_and_particles_of_an_image():
    image = micrograph()
    bar = I.scale_bar(image, 100.0)
    assert abs(bar["length_px"] - 100) <= 5 and abs(bar["nm_per_px"] - 1) < 0.1 and bar["polarity"] == "dark"
    found = [c for c in I.contours(image) if c["area_px"] > 50]
    assert len(found) == 4 and all(20 < np.sqrt(4 * c["area_px"] / np.pi) < 26 for c in found)
    assert I.scale_bar(255 - image, 100.0)["polarity"] == "light"
    assert (I.read_png(png(image)) == image).all()
    assert I.read_png(png(np.stack([image] * 3, -1))).shape == image.shape


def test_contours_are_polygons_through_border_centres():
    square = np.zeros((9, 12), bool)
    square[2:7, 3:11] = True
    square[4, 5] = False  # a hole doesn't count
    (box, own), = I.boxes(square)
    assert box == (3, 2, 8, 5) and I.measured(I.contour(own)) == (28.0, 22.0)
    dot = np.ones((1, 1), bool)
    assert I.measured(I.contour(dot)) == (0.0, 0.0)
    two = np.array([[1, 0, 1], [0, 0, 0], [1, 1, 0]], bool)
    assert I.labels(two).max() == 3 and I.labels(np.array([[1, 0], [0, 1]], bool)).max() == 1


def test_image_tables(spark):
    blank = np.full((100, 100), 128, np.uint8)
    df = spark.createDataFrame([("a/m.png", png(micrograph()), "100 nm"), ("b.png", png(blank), "scale bar"), ("c.png", b"no image", None)], "source string, image binary, label string")
    r = I.analyze_images(df, ["source"], label="label").cache()
    got = {x.source: x for x in I.summaries(r, ["source"], least_area=50).collect()}
    m = got["a/m.png"]
    assert m["count"] == 4 and 15 < m.mean_diameter_nm < 35 and m.std_diameter_nm is not None and m.min_diameter_nm <= m.median_diameter_nm <= m.max_diameter_nm
    assert got["b.png"]["count"] == 0 and got["b.png"].warnings == ["Scale label was provided, but no scale bar was detected."]
    assert got["c.png"].warnings[0].startswith("Could not read image")
    shown = {x.source: x for x in I.display_rows(I.summaries(r, ["source"], 50), ["source"]).collect()}
    assert shown["a/m.png"].particle_count == 4 and abs(shown["a/m.png"].scale_bar_px - 100) <= 5
    text = {x.source: x for x in writers.particle_table(I.summaries(r, ["source"], 50), ["source"]).collect()}
    assert text["a/m.png"].mean_diameter_px == f"{m.mean_diameter_px:.6g}" and text["b.png"].mean_diameter_nm == ""
    assert I.analyze_images(df.limit(0), ["source"]).count() == 0


def test_panels_are_measured_one_by_one(spark):
    page = np.full((300, 700), 255, np.uint8)
    page[20:260, 20:340] = micrograph()
    page[40:240, 400:402] = 0  # the axes and grid of a plot
    for y in range(60, 241, 45):
        page[y : y + 2, 400:640] = 0
    df = spark.createDataFrame([("p", png(page))], "source string, image binary")
    rows = I.analyze_images(df, ["source"], crop_panels=True).orderBy("index").collect()
    assert len(rows) == 2 and {r.panels[0].kind for r in rows} >= {"plot_or_histogram"}
    assert any("route this crop" in w for r in rows for w in r.warnings)
    boxes = spark.createDataFrame([("p", 10, 230, 100, 4), ("p", 5, 200, 60, 4), ("p", 5, 10, 90, 4)], "source string, x int, y int, w int, h int").withColumns({"iw": F.lit(320), "ih": F.lit(240)})
    assert I.best_bar(boxes, ["source"], "iw", "ih").first().length_px == 100


def test_measurements_of_figures_need_a_scale_and_a_material(spark):
    s = spark.createDataFrame([("a", 1, "x/f.png", 3, 5.0, 9.0, 1, ["w"]), ("a", 2, "x/g.png", 2, None, 9.0, None, []), ("b", 1, "x/h.png", 3, 5.0, 9.0, 1, []), ("a", 3, "x/i.png", 0, None, None, 1, [])], "article_id string, index int, source string, count int, mean_diameter_nm double, mean_diameter_px double, panel int, warnings array<string>")
    hint = spark.createDataFrame([("a", "m", "ceria", "CeO2")], "article_id string, material_id string, material_name string, material_formula string")
    rows, gone = R.vision_rows(s, hint)
    assert [(r.article_id, r.value, r.unit, r.condition, r.evidence, r.material_formula) for r in rows.collect()] == [("a", "5.0", "nm", "mean; count=3; panel=1", "w", "CeO2")]
    assert {(r.source_id, r.unit, r.reason, r.condition) for r in gone.collect()} == {("a:vision-2", "px", "vision particle measurements have no nm scale", "mean; g.png"), ("b:vision-1", "nm", "missing material formula hint for vision measurement", "mean; h.png")}


def test_pdf_payloads(spark):
    def tgz(*members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name, data in members:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    pdf = b"%PDF-1.7 x"
    assert downloads.pdf_of(pdf, "", "") == pdf and downloads.pdf_of(b"<html>", "application/pdf", "x.pdf") is None
    assert downloads.pdf_of(tgz(("a.txt", b"x"), ("bad.pdf", b"no"), ("d/b.PDF", pdf)), "", "") == pdf
    assert downloads.pdf_of(tgz(("a.txt", b"x")), "", "") is None
    answers = {"u1": (b"<html>", "text/html"), "u2": (tgz(("a.pdf", pdf)), "application/gzip")}

    def fetch(url):
        if url not in answers:
            raise OSError("refused")
        return answers[url]

    link = "array<struct<resolver:string,url:string>>"
    df = spark.createDataFrame([(1, "10.1/a", [("openalex", "u0"), ("openalex", "u1"), ("ncbi-oa", "u2")], None), (2, "", [], None), (3, "10.1/c", [("crossref", "u1")], b"half"), (4, "10.1/d", [], pdf), (5, "10.1/e", [], None)], f"k int, doi string, candidates {link}, have binary")
    got = {r.k: r for r in downloads.download(df, fetch, ["k"], have="have").collect()}
    assert [got[k].status for k in range(1, 6)] == ["downloaded", "skipped", "not-found", "exists", "not-found"]
    assert bytes(got[1].payload) == pdf and (got[1].resolver, got[1].url) == ("ncbi-oa", "u2") and len(got[1].warnings) == 2
    assert got[3].warnings[0].startswith("Existing file") and got[5].warnings == ["No PDF candidates found."] and got[1].file == "1.pdf"
    assert {r.status for r in downloads.download(df, fetch, ["k"], dry_run=True).collect()} == {"dry-run"}
    assert list(downloads.resolver_urls("10.1/a b")) == ["openalex", "ncbi-oa", "crossref"] and "10.1%2Fa%20b" in downloads.resolver_urls("10.1/a b")["crossref"]
    assert spark.range(1).select(downloads.pmc_id(F.parse_json(F.lit('{"records": [{"pmcid": " PMC1 "}]}')))).first()[0] == "PMC1"


def test_documents_take_tables_from_the_first_way_that_finds_any(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF- text"), ("b.PDF", b"bad"), ("c.txt", b"no")):
        (tmp_path / name).write_bytes(data)

    def parse(data):
        if data == b"bad":
            raise ValueError("broken")
        return "Body"

    ways = {"lattice": lambda _: [("1", [["", " "]])], "stream": lambda d: [("2", [["x", None], ["1", "2"]]), ("n/a", [["only"]])] if d != b"bad" else []}
    got = {r.source: r for r in readers.read_documents(spark, str(tmp_path), parse, ways).collect()}
    assert set(got) == {"a.pdf", "b.PDF"} and got["a.pdf"].parser == "docling+camelot" and got["b.PDF"].parser == "docling"
    assert got["a.pdf"].markdown == "Body\n\n## Table 1 (page 2)\n\n| x |  |\n| --- | --- |\n| 1 | 2 |\n\n## Table 2\n\n| only |\n| --- |"
    assert got["b.PDF"].markdown == "" and got["b.PDF"].warnings == ["docling failed to parse PDF: broken"]
    assert readers.read_documents(spark, str(tmp_path), None).first().warnings == ["docling is not installed; document text extraction was skipped.", "camelot is not installed; table extraction was skipped."]
    pages = readers.read_pages(spark, str(tmp_path), lambda data, scale, most: [bytes([round(scale)])] * 3, dpi=144, max_pages=2)
    assert sorted((r.source.rsplit("/")[-1], r.page, bytes(r.image)) for r in pages.collect()) == [(n, p, b"\x02") for n in ("a.pdf", "b.PDF") for p in (1, 2)]
    assert (readers.safe_int("3"), readers.safe_int("x"), readers.safe_int(None)) == (3, None, None)
    assert readers.token_from({"B": " t "}, ["A", "B"]) == "t" and readers.token_from({}, ["A"], "given") == "given" and readers.token_from({"A": " "}, ["A"]) is None


def test_benchmark_choices_and_payloads(spark, tmp_path):
    assert benchmark.pick_config(["nano_zymes_v1", "Nano-Zymes"], "Nanozymes") == "Nano-Zymes" and benchmark.pick_config(["x nanozymes"], "nanozymes") == "x nanozymes" and benchmark.pick_config(["a"], "b") is None
    assert benchmark.pick_splits(["train", "validation"], "test") == ["validation"] and benchmark.pick_splits(["train", "dev"], "test") == ["train", "dev"] and benchmark.pick_splits(["test", "train"], "test") == ["test"]
    spark.createDataFrame([("nano", "C", 1.23456789), ("other", "N", 2.0)], "task string, smiles string, value double").write.parquet(f"{tmp_path}/main/train")
    rows, said = benchmark.read_benchmark(spark, str(tmp_path), {"main": ["train"]}, "nano")
    assert rows.count() == 1 and said["domain_filter_applied"] and said["loaded_splits"] == ["train"]
    assert benchmark.gold_records(rows.withColumn("k", F.lit(1)), "k").first().value == "1.235"
    assert benchmark.read_benchmark(spark, str(tmp_path), {"main": ["train"]}, "zzz")[1]["domain_filter_warning"]
    df = spark.createDataFrame([(1, b"%PDF-x", "https://x.org/a.PDF", "t" * 600, "a/b.pdf", " "), (2, b"zz", None, "short text", None, None)], "k int, pdf binary, article_url string, full_text string, paper string, other string")
    got = {(r.source_id, r.field): (r.kind, r.suffix, r["size"]) for r in benchmark.article_artifacts(df, "k").collect()}
    assert got == {("1", "pdf"): ("bytes", ".pdf", 6), ("2", "pdf"): ("bytes", ".bin", 2), ("1", "article_url"): ("url", ".pdf", None), ("1", "full_text"): ("text", ".txt", None), ("1", "paper"): ("path", ".pdf", None)}


def test_embedding_answers():
    assert retrieval.matrix_of([1, 2]) == [[1.0, 2.0]] and retrieval.matrix_of(np.eye(2)) == [[1.0, 0.0], [0.0, 1.0]] and retrieval.matrix_of([np.array([1])]) == [[1.0]]
    for bad in ("x", [["a"], 3]):
        with pytest.raises(ValueError):
            retrieval.matrix_of(bad)


def test_jobs(spark, tmp_path):
    (tmp_path / "rows.csv").write_text("smiles,property_name,value,unit\nCCO,pMIC,5.1,uM\nCCO,pMIC,6,uM\n")
    (tmp_path / "gold.csv").write_text("SMILES,endpoint,label\nCCO,pMIC,5.1\nC,pMIC,1\n,pMIC,3\n")
    said = jobs.main(["aggregate", f"{tmp_path}/rows.csv", "--output", f"{tmp_path}/out"], spark)
    assert (said["input_rows"], said["clean_rows"], said["conflicts"]) == (2, 1, 1)
    said = jobs.main(["evaluate", f"{tmp_path}/gold.csv", f"{tmp_path}/rows.csv", "--mismatches", f"{tmp_path}/miss", "--json"], spark)
    assert (said["gold_records"], said["generated_records"], said["shared_keys"], said["missing_keys"], said["exact_value_matches"]) == (2, 2, 1, 1, 0)
    report = spark.read.option("header", True).csv(f"{tmp_path}/miss").collect()
    assert [(r.canonical_smiles, r.status) for r in report] == [("C", "missing"), ("CCO", "mismatch")]
    assert "key_recall=0.500000" in jobs.main(["evaluate", f"{tmp_path}/gold.csv", f"{tmp_path}/rows.csv"], spark)["text"]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "m.png").write_bytes(png(micrograph()))
    assert jobs.main(["images", f"{tmp_path}/img", "--output", f"{tmp_path}/vis", "--scale-label", "100 nm"], spark)["results"] == 1
    (tmp_path / "refs.csv").write_text("pdf,doi,title,access\np1,10.1/a,T,open\n")
    assert jobs.main(["download", f"{tmp_path}/refs.csv", "--output", f"{tmp_path}/dl", "--dry-run"], spark) == {"dry-run": 1}
    with pytest.raises(Exception, match="Invalid SMILES in g.csv at row 3"):
        from assayloom.operators import evaluate as E

        E.load_records(spark.createDataFrame([("C", "1", 0), ("?", "1", 1)], "smiles string, value string, o int"), "o", "g.csv", prop="smiles", canonical=lambda s: F.when(s != "?", s)).collect()


def test_an_article_bundle(spark, tmp_path):
    text = "Abstract\nx\n## Results\nCeria nanoparticles had a Km of 2 mM.\n"
    docs = spark.createDataFrame([("a 1", text, "Nanozymes"), ("b", "Plain text.", "Oxazolidinones")], "article_id string, markdown string, domain string")
    said = '{"rows": [{"formula": "CeO2", "property": "Km", "value": 2, "units": "mM"}]}'
    vision = spark.createDataFrame([("a 1", 1, "x/f.png", 3, 5.0, 9.0, 1, ["blurred"])], "article_id string, index int, source string, count int, mean_diameter_nm double, mean_diameter_px double, panel int, warnings array<string>")
    made = R.run_articles(docs, ask_nano=lambda df: df.select("article_id", "index", F.lit(said).alias("response")), vision=vision)
    m = {r.article_id: r for r in made.manifest.collect()}
    assert (m["a 1"].clean_rows, m["a 1"].vision_particle_count, m["a 1"].rejected_rows, len(m["a 1"].artifacts)) == (2, 3, 0, 11) and m["b"].clean_rows == 0
    assert [r.agent for r in made.trace.where("article_id = 'a 1'").orderBy("step").collect()][4] == "VisionAgent"
    writers.write_bundle(made, str(tmp_path), vision)
    assert {p.name for p in tmp_path.iterdir()} == {*R.ARTIFACTS, "manifest", "vision_json", "vision_summary_csv"}
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/clean_csv").where("article_id = 'a 1'").collect()
    assert {(r.property_name, r.source_type) for r in rows} == {("Km", "text"), ("particle diameter", "vision")}
    logs = [r.value for r in spark.read.text(f"{tmp_path}/logs").where("article_id = 'b'").collect()]
    assert logs[0].startswith("ParserAgent: Prepared 1 chunks") and len(logs) == 6
    assert writers.export_path("o", "d/Art icle.pdf", "clean") == "o/Art_icle_clean.csv" and writers.output_folder("r", "x/A b.pdf") == "r/A_b"
    assert json.loads(made.manifest.toJSON().first())["parser"] == "markdown"
