import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions import postings, presentation, text


def values(spark, items, expr):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string").select("i", expr(F.col("x")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_squeeze_takes_all_white_space(spark):
    odd = "".join(chr(c) for c in (0x1C, 0xA0, 0x2003, 0x85, 0x0B))
    assert values(spark, [f"  a{odd}b \n", None, "", " "], text.squeeze) == ["a b", "", "", ""]


def test_keys(spark):
    same = values(spark, ["ACME  Inc", " acme inc "], lambda x: text.application_key(x, F.lit("Dev"), F.lit("s")))
    assert same[0] == same[1]
    folded = values(spark, ["Straße", "STRASSE"], lambda x: text.role_company_key(x, F.lit("Dev")))
    assert folded[0] == folded[1]
    assert values(spark, [None], lambda x: text.digest(x, F.lit("b"))) == [None]


def test_issues(spark):
    found = values(spark, ["Summary\nx\nProfessional Profile �", "a\x07\x00", "itâ€™s", "fine\tfine\n", None], lambda x: text.issues(x, True))
    assert [sorted(f) for f in found] == [["possible_concatenation", "replacement_character"], ["control_character", "null_byte"], ["possible_mojibake"], [], []]


def test_structured_and_scored_part(spark):
    raw = "\r\n Role  X \r\n\r\n\r\nDo\tthings\rPay Range: 10\nsecret"
    assert values(spark, [raw], text.structured) == ["Role X\n\nDo things\nPay Range: 10\nsecret"]
    assert values(spark, [raw, "no end", "Benefits\nall", "Benefitsome\nall"], text.scored_part) == ["Role X\n\nDo things", "no end", "", "Benefitsome\nall"]


def test_chunks_keep_surrogate_pairs(spark):
    parts = values(spark, ["a" * 1999 + "🙂" + "b", ""], text.utf16_chunks)
    assert [len(p) for p in parts[0]] == [1999, 2] and parts[1] == []


def test_days_and_bands(spark):
    assert [str(d) for d in values(spark, ["2024-02-29T10:00", "2024-2-1", "2024-02-30", None], text.day)] == ["2024-02-29", "None", "None", "None"]
    bands = values(spark, ["75", "74.9", "55", "54"], lambda x: text.band(x.cast("double")))
    assert bands == ["Strong", "Moderate", "Moderate", "Weak"]


def test_posting_identity(spark):
    urls = ["https://www.linkedin.com/jobs/view/dev-at-x-123?refId=1", "https://www.linkedin.com/jobs/search?currentJobId=77", "https://boards.greenhouse.io/acme/jobs/42#app", "https://jobs.lever.co/acme/ab-12?x=1", "https://www.indeed.com/viewjob?jk=z9&from=a", "https://acme.wd1.myworkdayjobs.com/en/x/Dev_R1", "http://example.com?q=1"]
    assert values(spark, urls, postings.site) == ["LinkedIn", "LinkedIn", "Greenhouse", "Lever", "Indeed", "Workday", None]
    assert values(spark, urls, postings.job_id) == ["123", "77", "42", "ab-12", "z9", "Dev_R1", ""]
    assert values(spark, urls, postings.canonical_url) == ["https://www.linkedin.com/jobs/view/123", "https://www.linkedin.com/jobs/view/77", "https://boards.greenhouse.io/acme/jobs/42", "https://jobs.lever.co/acme/ab-12", "https://www.indeed.com/viewjob?jk=z9", "https://acme.wd1.myworkdayjobs.com/en/x/Dev_R1", "http://example.com/"]


def test_sponsorship(spark):
    texts = ["We cannot sponsor", "sponsorship is available", "US citizens or green card holders", "green card", "nothing"]
    assert values(spark, texts, lambda x: postings.sponsorship(x)[1]) == ["restricted", "clear", "restricted", "restricted", "warning"]


def test_extract(spark):
    page = "<html><script>var t='</p>'</script><article><h1>Dev &amp; Ops</h1><p>" + "long text " * 30 + "<!-- no --></p></article></html>"
    got = values(spark, [page, "<p>x", None], lambda x: postings.extract(x, F.lit("")))
    assert got[0].title == "Dev & Ops" and got[0].quality == "complete" and "no --" not in got[0].description
    assert [g.quality for g in got[1:]] == ["unavailable", "unavailable"]


def test_site_rules():
    long = "what you do " * 30
    assert postings.metadata("<title>Dev | Acme</title><h1> </h1><a href='/company/acme/'>Acme</a><div><h2>About the job</h2><p>" + long + "</p></div>", "LinkedIn")[:2] == ("Dev", "Acme")
    near = postings.metadata(f"<body><section><div><h2>About the job</h2></div><p>{long}</p></section></body>", "LinkedIn")
    assert near[2].startswith("About the job") and near[2].endswith("do") and near[3:] == ("original_saved", "complete")
    page = f"<div id='header'><span class='x company-name'>Acme</span></div><h1 class='app-title'>Dev</h1><h1>other</h1><div id='content'>{long}<br>end</div><div class='content'>short</div>"
    assert postings.metadata(page, "Greenhouse")[:2] == ("Dev", "Acme") and postings.metadata(page, "Greenhouse")[2].endswith("end")
    assert postings.metadata("<div class='posting-headline'><h2>Dev</h2></div><a class='main-header-logo'><img alt='Acme'></a><div class='posting'>text</div>", "Lever")[:3] == ("Dev", "Acme", "text")
    assert postings.metadata("<p data-testid='jobsearch-JobInfoHeader-title'>Dev</p><p id='jobDescriptionText'>text</p>", "Indeed")[:3] == ("Dev", "", "text")
    assert postings.metadata("<p data-automation-id='jobPostingHeader'>Dev</p><p data-automation-id='jobPostingDescription'>a<script>b</script></p>", "Workday")[2] == "a"
    assert postings.metadata("<title>Only</title>", "")[0] == "Only"


def test_unended_references_stay():
    page = "<h1>A&amp;&amp;&amp</h1><article>x &copy; &copy 2 &#65;&#65 &am</article>"
    assert postings.metadata(page, "")[0] == "A&&&amp" and postings.metadata(page, "")[2] == "x © &copy 2 A&#65 &am"
    assert postings.metadata("<h1>t</h1><a href='/company/?a=1&copy=2&amp;b=3'>Acme</a>", "")[1] == "Acme"


def test_labels_and_addresses_that_are_errors(spark):
    assert values(spark, ["No Fit", "Potential Fit", "Good Fit"], text.encoded_label) == [0, 1, 2]
    for items, expr in ((["Other"], text.encoded_label), (["ftp://x"], presentation.normal_url), (["odd"], presentation.source_label)):
        with pytest.raises(Exception, match="none of the known|an address begins|no such source"):
            values(spark, items, expr)


def test_presentation(spark):
    rows = spark.createDataFrame([(80.0, "Strong", None), (12.5, "weak", None), (50.0, "Weak", "Good Fit")], "score double, band string, fit string")
    shown, kind = presentation.score_text(F.col("score"), F.col("band"), F.col("fit"))
    assert [tuple(r) for r in rows.select(shown, kind).collect()] == [("80/100 (High)", "score-high"), ("12.5/100 (Low)", "score-low"), ("50/100 (Good Fit)", "score-high")]
    none = spark.range(1).select(presentation.decision(F.lit(None).cast("double"), F.lit(0.4), F.lit("x")).alias("d")).first().d
    assert none == []


def test_excluded_headings_are_told_from_the_lines_beginning(spark):
    rng = random.Random(3)
    bits = ["benefits", "Pay", "pay range", "EEO", "legal", "legally", "and", " ", "  ", "-", ":", "é", "&", "/", "\u212a", "perKs", "\x0b", "s", "2", "equal", "opportunity"]
    lines = ["", " ", "EEO", "e.e.o.:", "Pay-Range", "pay -- range", "(Perks) & more", "benefits and perks!", "benefitsand"] + ["".join(rng.choices(bits, k=rng.randint(1, 6))) for _ in range(800)]
    key = text.heading_key(F.col("t"))
    want = key.isin(*text.EXCLUDED_HEADINGS)
    for h in text.EXCLUDED_HEADINGS:
        want = want | key.startswith(f"{h} ")
    got = spark.createDataFrame([(x,) for x in lines], "t string").select(want.alias("a"), F.lower("t").rlike(text.EXCLUDED).alias("b")).collect()
    assert all(r.a == r.b for r in got) and 20 < sum(r.a for r in got) < 700


def test_scored_part_is_worked_out_once(spark):
    """Lines and headings aren't worked out anew wherever they are named: few expressions in the plan split a text."""
    body, quality = text.capped(F.col("t"), F.lit("complete"), 1000)
    plan = spark.createDataFrame([("a",)], "t string").select(body.alias("body"), quality.alias("quality"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 4  # body and quality, two each
