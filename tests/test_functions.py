import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.functions import code, meta, scoring, text, vector
from memspark.functions.hashing import content_hash, hash_embed, hash_hex


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(column.alias("v")).first()
    return row["v"]


@pytest.mark.parametrize(
    "given, want",
    [
        ("getUserName verify_password authFlow2", "get user name verify password auth flow 2"),
        ("Foo-Bar_Baz, x.y; f() {}", "foo bar baz , x . y ; f ( ) { }"),
        ("get_user_name", "get user name"),
        ("HTTPRequest", "http request"),
        ("key: value", "key : value"),
        ("___ é", "___"),
        ("", ""),
    ],
)
def test_tokenize(spark, given, want):
    assert one(spark, text.tokenize("t"), t=given) == want.split()


def test_features(spark):
    assert one(spark, text.features("t"), t="a b c") == ["a", "b", "c", "a_b", "b_c"]
    assert one(spark, text.features("t"), t="a") == ["a"]
    assert one(spark, text.features("t"), t="") == []


def test_hash_embedding_golden(spark):
    got = one(spark, hash_embed("t", 8), t="how does authentication work")
    np.testing.assert_allclose(got, [0.5547001962252291, 0, -0.2773500981126146, 0, 0.5547001962252291, 0, 0, 0.5547001962252291], atol=1e-6)
    got = one(spark, hash_embed("t", 16), t="auth uses JWT with 24h expiry")
    third = 1 / 3
    np.testing.assert_allclose(got, [third, 0, third, 0, 0, 0, third, 0, 0, 0, -third, 0, -third, 2 * third, 0, 0], atol=1e-6)


def test_content_hash_golden(spark):
    assert hash_hex(b"auth uses JWT with 24h expiry") == "f0d62f8e497d333aee48761e52f72956"
    assert one(spark, content_hash("t"), t="auth uses JWT with 24h expiry") == "f0d62f8e497d333aee48761e52f72956"


def test_query_types(spark):
    assert one(spark, text.infer_query_types("t"), t="Where is recall?") == ["code_symbol", "code_file"]
    assert one(spark, text.infer_query_types("t"), t="how to deploy") == ["playbook"]
    assert one(spark, text.infer_query_types("t"), t="weather") == []


def test_noise(spark):
    for t, want in (("OK lol", True), ("", False), ("ok fine", False), ("  test ", True)):
        assert one(spark, text.is_noise("t"), t=t) is want


def test_renderings(spark):
    assert one(spark, text.playbook_content(F.lit("n"), F.array(F.lit("a"), F.lit("b")))) == "n\n1. a\n2. b"
    assert one(spark, text.playbook_content(F.lit("n"), F.array().cast("array<string>"))) == "n\n"
    assert one(spark, text.episode_content(F.lit("u"), F.lit("do"), F.lit(""), F.lit("ok"))) == "agent=u | action=do | outcome=ok"
    assert one(spark, text.json_object("t"), t='```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'


@pytest.mark.parametrize(
    "m, string, truth, number",
    [
        ('{"k":"v"}', "v", True, None), ('{"k":""}', "", False, None), ('{"k":"2.5"}', "2.5", True, 2.5), ('{"k":0}', "", False, 0.0), ('{"k":3}', "", True, 3.0), ('{"k":true}', "", True, None), ('{"k":false}', "", False, None),
        ('{"k":null}', "", False, None), ("{}", "", False, None), ('{"k":[1]}', "", True, None), ("broken", "", False, None),
    ],
)
def test_meta(spark, m, string, truth, number):
    assert one(spark, meta.string("m", "k"), m=m) == string
    assert one(spark, meta.truthy("m", "k"), m=m) is truth
    assert one(spark, meta.number("m", "k"), m=m) == number


def test_meta_entries(spark):
    import json

    got = one(spark, meta.with_entries("m", b=F.lit("x"), c=F.lit(None).cast("string"), d=F.lit(True)), m='{"a": 1, "b": "old, \\"q\\"", "c": "stay", "n": {"z": [1, 2]}}')
    assert json.loads(got) == {"a": 1, "c": "stay", "n": {"z": [1, 2]}, "b": "x", "d": True}
    assert json.loads(one(spark, meta.with_entries("m", b=F.lit(1.5)), m="{}")) == {"b": 1.5}
    assert json.loads(one(spark, meta.with_entries("m", b=F.lit("y")), m='{"b":"x"}')) == {"b": "y"}


def test_scoring(spark):
    assert one(spark, scoring.recency(F.lit(0.0), 10.0, 10.0)) == 0.5
    assert one(spark, scoring.recency(F.lit(20.0), 10.0, 10.0)) == 1.0
    assert one(spark, scoring.frequency(F.lit(-3))) == 0.0
    got = one(spark, scoring.activation(F.lit(-0.5), F.lit(0.0), F.lit(1), F.lit(None).cast("int"), F.lit("fact"), F.array(F.lit("fact")), 0.0))
    assert math.isclose(got, 0.3 + 0.2 * math.log(2) + 0.25)
    assert one(spark, scoring.expanded_similarity(F.lit(0.01), F.lit(1), 0.5)) == 0.05


def test_vectors(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert math.isclose(one(spark, vector.cosine(a(1, 1), a(1, 0))), math.sqrt(0.5))
    assert one(spark, vector.cosine(a(0, 0), a(1, 0))) == 0.0
    assert one(spark, vector.cosine(a(1, 0, 0), a(1, 0))) == 0.0
    assert one(spark, vector.normalise(a(0, 0))) == [0.0, 0.0]


def test_code_functions(spark):
    for p, lang, module in (("a/b.PY", "python", "a.b.PY"), ("x/y/index.js", "javascript", "x.y"), ("k.tsx", "typescript", "k.tsx"), ("Makefile", None, "Makefile"), (".py", "python", "module")):
        assert one(spark, code.language("p"), p=p) == lang
        assert one(spark, code.module_name("p"), p=p) == module
    assert one(spark, code.ignored("p"), p="a/node_modules/x.js") is True
    assert one(spark, code.ignored("p", ["generated_*"]), p="a/generated_x.py") is True
    assert one(spark, code.ignored("p", ["**/x/**"]), p="a/x/y.py") is False
    assert one(spark, code.is_identifier("p"), p="é_1") is True
    assert one(spark, code.is_identifier("p"), p="1a") is False
