import pytest
from pyspark.sql import functions as F

from orrery.functions import normal, tails
from orrery.functions import scalars as S
from orrery.functions.hashing import poisson_weight, standard_normal, uniform
from orrery.operators import tags as TG
from orrery.operators import text as TX


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_gap_fill_golden(spark):
    bands = [None, 123.0, 1.0, None, 12.0, 11.3, None]
    got = one(spark, *[c.alias(f"b{i}") for i, c in enumerate(S.fill_band_gaps([F.lit(b).cast("double") for b in bands]))])
    assert list(got) == [123, 123, 1.0, 6.5, 12.0, 11.3, 11.3]


def test_gap_fill_sees_filled_left_neighbour(spark):
    bands = [1.0, None, None, None, None, None, None]
    got = one(spark, *[c.alias(f"b{i}") for i, c in enumerate(S.fill_band_gaps([F.lit(b).cast("double") for b in bands]))])
    assert list(got) == [1.0] * 7


def test_position_golden(spark):
    ra = S.sexagesimal_degrees(S.sexagesimal_parts(F.lit("05h55m10.30536s")), hours=True)
    dec = S.sexagesimal_degrees(S.sexagesimal_parts(F.lit("+07d24m25.4304s")))
    minus = S.sexagesimal_degrees(S.sexagesimal_parts(F.lit("-00d30m00s")))
    got = one(spark, ra.alias("a"), dec.alias("b"), minus.alias("c"))
    assert got[0] == pytest.approx(88.792939, abs=1e-6)
    assert got[1] == pytest.approx(7.407064, abs=1e-6)
    assert got[2] == -0.5


def test_pad_and_separation(spark):
    got = one(
        spark,
        S.pad_sexagesimal(F.array(F.lit("12"), F.lit("19.4"))).alias("a"),
        S.pad_sexagesimal(F.array(F.lit("12"), F.lit("19"))).alias("b"),
        S.separation_arcsec(F.lit(10.0), F.lit(0.0), F.lit(10.0), F.lit(1.0)).alias("c"),
    )
    assert got[0] == ["12", "00", "19.4"] and got[1] == ["12", "19", "00"]
    assert got[2] == pytest.approx(3600)


def test_text_cells(spark):
    got = one(
        spark,
        S.collapse_blanks(F.lit("[SMN83] RCW  16 1")).alias("a"),
        S.replace_packed(F.lit("blah;blup; bleep"), "blup", "blap").alias("b"),
        S.number_or_null(F.lit("1.5d")).alias("c"),
        S.number_or_null(F.lit(" 2e3 ")).alias("d"),
        S.line_flag(F.lit(None).cast("double")).alias("e"),
        S.flux_magnitude(F.lit(0.0)).alias("f"),
        S.category_label(F.lit("some Col-umn v")).alias("g"),
    )
    assert list(got) == ["[SMN83] RCW 16 1", "blah;blap;bleep", None, 2000.0, 1.0, None, "SomeColumnV"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("and 119 more", None),
        ("submillimetre", "submillimeter"),
        ("stars, binary", None),
        ("NGC 2293", None),
        ("X-rays: general", "x ray sources"),
        ("Exoplanets", "planetary systems"),
        ("galaxies: individual (M31)", "galaxies"),
        ("dust", None),
        ("abc", None),
        ("H2O masers 22", "chemistry"),
    ],
)
def test_clean_tag(spark, raw, expected):
    assert one(spark, TG.clean_tag(F.lit(raw)).alias("t"))[0] == expected


def test_tag_rules_from_table_keep_first_position(spark):
    rows = [("prefix", 1, "radio", "radio"), ("prefix", 2, "super", "novae"), ("prefix", 3, "radio", "spectral"), ("ignore", 4, "mapping", None)]
    rules = TG.TagRules.from_table(spark.createDataFrame(rows, "kind string, pos int, old string, new string"))
    assert rules.prefixes == [("radio", "spectral"), ("super", "novae")] and rules.ignore == ["mapping"]
    got = one(spark, TG.clean_tags(F.array(F.lit("supernovae are cool"), F.lit("Radio lines"), F.lit("mapping")), rules).alias("t"))
    assert got[0] == ["novae", "spectral"]


def test_tokens(spark):
    text = "We cannot see http://a.b/c?d=1, the 3 stars shine."
    got = one(spark, TX.tokens(F.lit(text)).alias("t"), TX.urls(F.lit(text)).alias("u"))
    assert got[0] == ["We", "can", "not", "see", "placeholderurl", "the", "stars", "shine"]
    assert got[1] == ["http://a.b/c?d=1,"]


def test_tokens_of_joined_words_and_gaps(spark):
    text = "Cannot(CANNOT) cannots\u2003gonna\x85wanna_x9y \\[a]^b-c&&d https://a.b/cannot ~"
    words = ["Can", "not", "CAN", "NOT", "cannots", "gon", "na", "wan", "na", "x", "y", "a", "b", "c", "d", "placeholderurl"]
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " 12 .")], "doc_id long, text string")
    got = {r.doc_id: r.t for r in docs.select("doc_id", TX.tokens(F.col("text")).alias("t")).collect()}
    assert got == {1: words, 2: None, 3: [], 4: []}
    rows = TX.token_rows(docs, "doc_id", "text")
    assert sorted(r.token for r in rows.collect()) == sorted(w.lower() for w in words if w.lower() not in TX.ENGLISH_STOP_WORDS)
    # No lambda runs once per word: such lambdas are interpreted.
    assert "filter(" not in rows._jdf.queryExecution().optimizedPlan().toString() and "transform(" not in rows._jdf.queryExecution().optimizedPlan().toString()

def test_normal_and_tails(spark):
    got = one(spark, normal.cdf(F.lit(1.96)).alias("a"), normal.cdf(F.lit(-6.0)).alias("b"), normal.erfc(F.lit(0.1)).alias("c"))
    assert got[0] == pytest.approx(0.9750021048517795, rel=1e-13)
    assert got[1] == pytest.approx(9.865876450376946e-10, rel=1e-11)
    assert got[2] == pytest.approx(0.8875370839817152, rel=1e-13)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-8)
    assert tails.binomial_cdf(3, 10) == pytest.approx(176 / 1024)
    assert tails.binomial_cdf(-1, 10) == 0.0


def test_hash_draws(spark):
    df = spark.range(20000).select(
        uniform(5, "id").alias("u"), standard_normal(5, "id").alias("z"), poisson_weight(5, 0.2, "id").alias("p")
    )
    row = df.agg(F.avg("u"), F.avg("z"), F.stddev("z"), F.avg("p"), F.var_pop("p")).first()
    assert row[0] == pytest.approx(0.5, abs=0.01) and row[1] == pytest.approx(0, abs=0.03) and row[2] == pytest.approx(1, abs=0.03)
    assert row[3] == pytest.approx(0.2, abs=0.015) and row[4] == pytest.approx(0.2, abs=0.02)
    again = spark.range(0, 20000, 1, 13).select(uniform(5, "id").alias("u")).agg(F.sum("u")).first()[0]
    assert again == pytest.approx(df.agg(F.sum("u")).first()[0])


def test_vocabulary_cleans_distinct_tags(spark):
    """The cleaning stays above the distinct; by a filter it was pushed below and ran on every occurrence."""
    papers = spark.createDataFrame([(1, ["Dust", "exoplanets", None]), (2, ["Dust", "and 119 more"]), (2, ["Exoplanets"]), (None, ["exo-planets"])], "id long, words array<string>")
    words = TG.vocabulary(papers, "words")
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" not in plan[plan.rindex("Aggregate [_raw") :].lower()
    clean = {r.tag for r in papers.select(F.explode(TG.clean_tags(F.col("words"))).alias("tag")).collect()}
    assert {r.tag for r in words.collect()} == clean
    whole = TG.papers_with_tag(papers, "words", "PLANET").select("id").distinct().collect()
    assert {r.id for r in TG.ids_with_tag(papers, "id", "words", ["PLANET"]).collect()} == {r.id for r in whole} != set()


def test_every_containment_text_holds_a_fragment():
    from orrery.operators import tags as TG

    texts = [old for old, _ in TG.TagRules().contains if old]
    found = TG._fragments(texts)
    assert len(found) < len(texts) / 2 and all(any(f in t for f in found) for t in texts)
    assert TG._fragments(["v m", "galaxies", "dwarf galaxies"]) and TG._fragments([]) == []


def test_rules_reach_tags_with_and_without_fragments(spark):
    from pyspark.sql import functions as F

    from orrery.operators import tags as TG

    rules = TG.TagRules(contains=[("ab", "xyzw"), ("yzwq", "done"), ("long text", "short")], prefixes=[], ignore=[])
    # The second rule meets what the first one made; one tag holds a fragment but no text.
    tags = ["one abq", "a long text b", "a long tex", "plain"]
    got = spark.createDataFrame([(tags,)], "tags array<string>").select(TG._replace_contained(F.col("tags"), rules)).first()[0]
    assert got == ["one xdone", "a short b", "a long tex", "plain"]
