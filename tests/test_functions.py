import pytest
from pyspark.sql import functions as F

from strata.functions import keys, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_cells_floor_and_flag_missing(spark):
    e, n = F.col("e"), F.col("n")
    assert one(spark, keys.grid_cell(e, n), e=234567, n=345678) == "BNG_100KM_E2_N3"
    assert one(spark, keys.grid_cell(e, n, 25), e=-1, n=0) == "BNG_25KM_E-1_N0"
    assert one(spark, keys.grid_cell(F.lit(None).cast("long"), F.lit(5))) == "UNAVAILABLE"
    with pytest.raises(ValueError):
        keys.grid_cell(e, n, 0)


def test_opaque_ids_match_published_ones(spark):
    assert one(spark, keys.opaque_id(keys.SAMPLE_PREFIX, "E001-terrain-v1", F.lit(1008509))) == "E001P-d68c620e09d5"


def test_hash_draws_are_exact(spark):
    import hashlib

    h = hashlib.sha256(b"a:b").digest()
    assert one(spark, keys.unit_draw(keys.hash_rank("a", F.lit("b")))) == int.from_bytes(h[:8], "big") / 2**64
    assert one(spark, keys.unit_draw(keys.hash_rank("a", F.lit("b")), 1, 8)) == int.from_bytes(h[:4], "big") / 2**32


@pytest.mark.parametrize(
    "title, category",
    [
        ("Bowl barrow 200m north of the farm", "probable_bowl_candidate"), ("Two bowl barrows on the down", "clear_title_exclusion"), ("Bell barrow on the hill", "clear_title_exclusion"),
        ("Long barrow", "clear_title_exclusion"), ("Round barrow cemetery", "clear_title_exclusion"), ("A barrow", "manual_review_required"), ("Bowl  barrow ", "probable_bowl_candidate"), ("A castle", None),
    ],
)
def test_titles(spark, title, category):
    got = one(spark, text.triage_title(F.col("t")), t=title)
    assert (got.category if got else None) == category


@pytest.mark.parametrize(
    "details, status, reason",
    [
        ("The monument includes a bowl barrow. The mound stands 1.4m high.", "needs_geometry_review", None), ("It is visible only as a cropmark.", "rejected", "cropmark_only"),
        ("It has been entirely levelled.", "rejected", "no_upstanding_relief"), ("It was wholly removed.", "rejected", "destroyed_or_reconstructed"), ("It comprises a round cairn.", "rejected", "cairn"),
        ("The monument includes three barrows.", "rejected", "compound_or_multiple"), ("Nothing is known of it.", "uncertain", "insufficient_evidence"),
    ],
)
def test_entries(spark, details, status, reason):
    got = one(spark, text.assess_entry(F.lit("This is a bowl barrow."), F.col("d")), d=details)
    assert (got.status, got.reason) == (status, reason)


def test_several_monuments_are_sought_in_the_opening_only(spark):
    late = "x " * 360 + "The monument includes two bowl barrows. The mound survives."
    assert one(spark, text.assess_entry(F.lit("A bowl barrow."), F.col("d")), d=late).status == "needs_geometry_review"


def test_diameters(spark):
    d = text.described_diameter(F.col("d"))
    assert one(spark, d, d="The mound measures 12m by 10m. The barrow is 22.5 m in diameter. A ditch 70m across.") == 22.5
    assert one(spark, d, d="The mound is 95m across.") is None
    assert one(spark, d, d="A pit 12m across.") is None


def test_plain_text(spark):
    for bad in ("<b>", "see http://x", "../up", "nul\x00"):
        assert not one(spark, text.safe_plain_text(F.col("t")), t=bad)
    assert one(spark, text.safe_plain_text(F.col("t")), t="A line.\nAnother.")


def test_line_ends_do_not_change_a_digest(spark):
    assert one(spark, text.line_digest(F.col("t")), t="a\r\nb") == one(spark, text.line_digest(F.col("t")), t="a\nb")
