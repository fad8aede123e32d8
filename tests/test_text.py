from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.functions import markup, records, text


@pytest.mark.parametrize("forms", [["катана", "катану", "катаны", "катаной"], ["косплей", "косплея", "косплею"], ["пельмени", "пельменей", "пельменями"], ["музей", "музея"]])
def test_forms_share_a_nominal_stem(forms):
    assert len({text.russian_nominal(w) for w in forms}) == 1


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("roll", "roll")])
def test_porter(word, stem):
    assert text.english(word) == stem


def test_scripts():
    assert text.stems("abc123") == ["abc123"] and text.stems("ёлка")[0].startswith("елк")
    assert text.query_stems("катана") == ["катан"]
    assert text.tokens("Ёж_и Foo-bar 12") == ["еж", "и", "foo", "bar", "12"]


def plain_osa(a, b):
    d = {}
    for i in range(-1, len(a)):
        d[i, -1] = i + 1
    for j in range(-1, len(b)):
        d[-1, j] = j + 1
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(1, 3))
def test_distance_is_osa(a, b, limit):
    assert text.within(a, b, limit) == min(plain_osa(a, b), limit + 1)


def test_distance_values():
    assert text.within("abcd", "abdc", 2) == 1 and text.within("ca", "abc", 3) == 3


def test_columns(spark):
    row = spark.createDataFrame([("каcплей", "rfnfyf", "  Материал  УДАЛЁН!.. ", "https://x.org/u/136-n", "@petra", "https://x.org/games/123-a-b?comment=9", "https://api.x.org/v2/redirect?to=https%3A%2F%2Fy.org%2Fz")], "a string, b string, c string, d string, e string, f string, g string")
    k1, v1 = text.user_ident(F.col("d"))
    k2, v2 = text.user_ident(F.col("e"))
    p, c = text.post_ref(F.col("f"))
    got = row.select(text.unalike(F.col("a")), text.to_layout(F.col("b"), "ru"), text.guard_norm(F.col("c")), k1, v1, k2, v2, p, c, text.unwrap_url(F.col("g")), text.slug(F.col("f"))).first()
    assert list(got) == ["касплей", "катана", "материал удален", "id", "136", "uri", "petra", 123, 9, "https://y.org/z", "a-b"]


def test_rich():
    r = markup.rich('<p>Hi <b>you</b> <script>no</script><a href="javascript:x">l</a><a href="https://a.b/c">m</a></p><ul><li>1<li>2</ul><p>a<br>b')
    assert "script" not in r["html"] and "javascript" not in r["html"]
    assert "**you**" in r["md"] and "[m](https://a.b/c)" in r["md"]
    assert r["text"].startswith("Hi you lm") and r["text"].endswith("a\nb")
    assert markup.rich(None) == {"html": "", "md": "", "text": ""}


def test_comment_text_and_media():
    assert markup.comment_plain("> a\r\n> b\r\nhi <mention id=\"1\">@Bob</mention> x<3") == "> a\n> b\nhi @Bob x<3"
    u = "0f8fad5b-d9cb-469f-a165-70867728950e"
    doc = {"a": [{"uuid": u.upper(), "size": 5, "type": "jpg"}, {"b": {"uuid": u}}], "skip": {"uuid": "1" + u[1:]}}
    assert markup.media_of(doc, skip=("skip",)) == [{"key": u, "signature": "5|||jpg||", "kind": "jpg"}]
    assert markup.harvest({"x": {"title": "<b>T</b>", "url": "https://q.w/"}}) == {"texts": ["T"], "urls": ["https://q.w/"]}


def test_reactions(spark):
    rows = spark.createDataFrame([([("1", "3"), ("27", "5"), ("2", "0"), ("9", "x")],)], "c array<struct<id:string,count:string>>")
    pairs = records.reaction_pairs(F.col("c"))
    got = rows.select(pairs.alias("p"), records.reactions_total(pairs).alias("n")).first()
    assert [tuple(x) for x in got["p"]] == [("27", 5), ("1", 3)] and got["n"] == 8
