"""Scalar functions against hand-made cases."""

import re

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from staylens.functions import lexicon, parse, text
from staylens.operators import quality, search, understanding


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


TEXT = [
    (text.clean, "  xem http://a.b/c  và www.x.y nhé ", "xem và nhé"),
    (text.clean, None, ""),
    (text.clean, "a\u200bb\u00a0 c", "a b c"),
    (text.normalize, "Phòng đẹpppp!!! ngonnnn  ĐÀ NẴNG 5* 111 _x", "phòng đẹp ngon đà nẵng 5 111 _x"),
    (text.normalize, "www", "w"),
    (text.normalize, "", ""),
    (text.tokens, "View đẹp_lắm, 5*", ["view", "đẹp_lắm", "5"]),
    (text.tokens, None, []),
    (text.words, "Hồ-bơi, A_b!", ["hồ", "bơi", "a_b"]),
    (text.sentences, "Một. Hai!  Ba? bốn", ["Một.", "Hai!", "Ba?", "bốn"]),
    (text.suggestions, "biển biển đẹp", ["biển biển đẹp", "khách sạn biển đẹp", "resort biển đẹp", "homestay biển đẹp"]),
    (text.lexicon_sentiment, "tốt tốt tệ", "neutral"),
    (text.lexicon_sentiment, "tốt đẹp tệ", "positive"),
    (text.lexicon_sentiment, None, "neutral"),
    (quality.is_spam, "", True),
    (quality.is_spam, "1234567", True),
    (quality.is_spam, "12345678", False),
    (quality.is_spam, "ok aaaaaaaa", True),
    (quality.is_spam, "ok aaaaaaa.", False),
    (quality.is_spam, "Gọi HOTLINE để biết", True),
    (quality.is_vietnamese, "très bon hôtel", True),
    (quality.is_vietnamese, "good hotel", False),
    (quality.is_vietnamese, None, False),
    (quality.is_vietnamese_short, "phong sach", True),
    (parse.score_to_5, "8,5", "4.2"),
    (parse.score_to_5, "4.2", "4.2"),
    (parse.score_to_5, "10", "5.0"),
    (parse.score_to_5, "7.1", "3.5"),
    (parse.score_to_5, "abc", ""),
    (parse.score_to_5, None, ""),
    (parse.iso_timestamp, "1700000000", "2023-11-14T22:13:20+00:00"),
    (parse.iso_timestamp, "1700000000000", "2023-11-14T22:13:20+00:00"),
    (parse.iso_timestamp, "soon", "soon"),
    (parse.hotel_id, "https://h.x/hotel/detail?spec=1.1.HOTEL.9000123.Name.1", "9000123"),
    (parse.hotel_id, "https://h.x/x-hotel-123456?y=1", "123456"),
    (parse.hotel_id, "https://h.x/?hotelId=77", ""),
    (parse.hotel_id, "https://h.x/?objectId=1&hotel_id=ab55555c", "55555"),
    (parse.name_key, "A & B's  Hôtel!", "a and b's hôtel"),
    (search.asked_type, "tìm resort gần biển", "resort"),
    (search.asked_type, "chỗ ở", None),
]


@pytest.mark.parametrize(("function", "value", "want"), TEXT)
def test_text(spark, function, value, want):
    assert one(spark, function(F.col("v")), v=value) == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aáĐ đ1_.!\n😀k", max_size=30), min_size=1, max_size=40))
def test_normalize_against_plain_python(spark, values):
    def plain(v):
        v = re.sub(r"[^\w\s]+", " ", v.lower().strip())
        v = re.sub(r"([a-zà-ỹđ])\1{2,}", r"\1", v)
        return re.sub(r"\s+", " ", v).strip()

    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", text.normalize(F.col("v")))
    assert rows(df) == sorted([(i, plain(v)) for i, v in enumerate(values)], key=repr)


def test_arrays(spark):
    assert one(spark, text.without(F.col("v"), ["và"]), v=["A", "Và", "B", "A"]) == ["A", "B", "A"]
    assert set(one(spark, text.forms(F.col("v")), v=["hồ_bơi"])) == {"hồ_bơi", "hồ", "bơi"}
    assert one(spark, text.ngrams(F.col("v"), 2), v=["a", "b", "c"]) == ["a_b", "b_c"]
    assert one(spark, text.ngrams(F.col("v"), 3), v=["a"]) == []
    assert one(spark, text.positive_tags(F.col("v")), v=["Gần biển", "!x", "bad_y", "tệ", "", "ok"]) == ["gần_biển", "ok"]
    assert one(spark, quality.tag_conflicts(F.col("v")), v=["a", "!a", "b", "!c"]) == ["a"]
    assert one(spark, quality.without_unwanted(F.col("v"), F.col("w")), v=["!pool"], w=["hồ_bơi"]) is False
    assert one(spark, quality.without_unwanted(F.col("v"), F.col("w")), v=["!pool"], w=["wifi"]) is True


def test_pages(spark):
    html = '<script type="application/ld+json">{"@type": "Resort", "address": {"streetAddress": "1 Phố A"}}</script><a href="/d?spec=1.2.HOTEL.123456.Nha%20Dep.1&x=1">'
    assert one(spark, parse.jsonld(F.col("v"), "$.address.streetAddress"), v=html) == "1 Phố A"
    assert [tuple(t) for t in one(spark, parse.page_targets(F.col("v")), v=html)] == [("1.2.HOTEL.123456.Nha Dep.1", "123456", "Nha Dep")]
    assert one(spark, parse.page_types(parse.jsonld(F.col("v"), "$.@type"), F.lit(""), F.lit("")), v=html) == ["resort"]
    assert one(spark, parse.page_types(F.col("v"), F.lit("một khu nghỉ dưỡng"), F.lit("")), v=None) == ["resort"]
    assert one(spark, parse.page_types(F.col("v"), F.lit("chỗ nghỉ"), F.lit("Villa Căn hộ")), v="Hotel") == ["hotel", "villa", "aparthotel"]
    assert one(spark, parse.is_address(F.col("v"), F.lit("huế")), v="12 đường Lê Lợi, Huế") is True
    assert one(spark, parse.is_address(F.col("v"), F.lit("huế")), v="nhân viên ở Huế, thân thiện") is False
    assert one(spark, parse.absolute_url(F.col("v"), "https://h"), v="/a") == "https://h/a"
    assert one(spark, parse.review_id("stay", F.lit("9001"), F.lit(None), F.col("v"), F.lit("4.5"), F.lit("1700000000000")), v=" Phòng sạch ") == "stay_9001_5b4b279fc7dfc320"


def test_payload(spark):
    payload = '{"data": {"reviews": [{"reviewId": "1", "reviewOriginalText": "tốt", "reviewReply": {"replyText": "x"}}], "hasNext": false}}'
    assert one(spark, parse.payload_reviews(F.col("v")), v=payload)[0]["reviewReply"]["replyText"] == "x"
    assert one(spark, parse.payload_reviews(F.col("v")), v="{bad") is None


@pytest.mark.parametrize(
    ("wishes", "review", "want"),
    [([], "x", True), (["rất"], "x", True), (["view", "biển"], "có view biển đẹp", True), (["view", "biển"], "có biển", False), (["hồ_bơi"], "có pool to", True), (["hồ_bơi"], "không có", False)],
)
def test_descriptor_support(spark, wishes, review, want):
    assert one(spark, search.descriptors_supported(F.col("w"), F.array("r")), w=wishes, r=review) is want


@pytest.mark.parametrize(
    ("review", "wishes", "want"),
    [("bẩn và dơ", ["sạch"], 0.6), ("bẩn và dơ", ["x"], 0.7), ("bẩn, hơi xa", ["sạch"], 0.75), ("bẩn, hơi xa", ["x"], 0.8), ("bẩn", ["sạch"], 0.8), ("bẩn", ["x"], 0.85), ("hơi xa", ["sạch"], 1.0)],
)
def test_complaints(spark, review, wishes, want):
    assert one(spark, search.complaint_factor(F.array("r"), F.col("w"), F.array().cast("array<string>")), r=review, w=wishes) == want


def test_type_factor(spark):
    assert one(spark, search.type_factor(F.col("q"), F.col("t")), q="một resort", t=["resort"]) == 1.2
    assert one(spark, search.type_factor(F.col("q"), F.col("t")), q="một resort", t=["hotel"]) == 0.85
    assert one(spark, search.type_factor(F.col("q"), F.col("t")), q="chỗ", t=["hotel"]) == 1.0


def test_understanding(spark):
    df = spark.createDataFrame([("tôi muốn tìm view biển ở phú quốc",), ("",), (None,)], "q string")
    got = understanding.understand(df, "q", lexicon.aliases({"phú_quốc": ["phú quốc", "phu quoc"]}), ["view", "biển"], {"biển": ["biển", "beach"]}).collect()
    assert got[0]["core_tokens"] == ["view", "biển"] and got[0]["detected_location"] == "phú_quốc" and got[0]["descriptor_tokens"] == ["view", "biển"]
    assert got[0]["expanded_tokens"] == ["view", "biển", "beach", "phú_quốc"] and got[0]["detected_categories"] == ["beach"]
    assert all(r["core_tokens"] == [] and r["detected_location"] is None for r in got[1:])


def test_lexicons(tmp_path):
    (tmp_path / "s.txt").write_text("# note\nVà\n\n là \n", encoding="utf-8")
    assert lexicon.word_list(str(tmp_path / "s.txt")) == ["và", "là"] and lexicon.word_list(str(tmp_path / "no")) == []
    assert lexicon.rules({"t": {"positive": ["A_b"], "negative": ["c"]}, "u": None}) == [("a b", "t", False), ("c", "t", True)]
    assert lexicon.keywords({"đà_nẵng": ["da nang", "đà nẵng"]}) == {"đà_nẵng": ["đà nẵng", "da nang"]}
    yaml = pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text(yaml.safe_dump({"tags": {"t": {"positive": ["x"]}}}), encoding="utf-8")
    assert lexicon.read_rules(str(tmp_path / "r.yaml"), "tags") == [("x", "t", False)]


def test_targets_in_json_of_any_depth(spark):
    payload = '{"data": {"title": "Nhà", "list": [{"name": "A", "link": {"hotelSeoUrl": "/a"}}, {"hotelSeoUrl": "/b"}, {"name": "C", "hotelSeoUrl": "/a"}]}}'
    assert [tuple(t) for t in one(spark, parse.json_targets(F.col("v")), v=payload)] == [("/a", "A"), ("/b", "Nhà")]
    assert one(spark, parse.json_targets(F.col("v")), v="{") == [] and one(spark, parse.json_targets(F.col("v")), v=None) == []
