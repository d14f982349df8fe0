import pytest
from pyspark.sql import functions as F

from jouleframe.functions import keys


def sigs(df):
    return [r[0] for r in df.select(keys.signature(df)).collect()]


def test_golden_signatures(spark):
    g = spark.createDataFrame([("gemm", "bf16", 4096, 3072, 3072)], "category string, dtype string, p_m long, p_n long, p_k long")
    assert sigs(g) == ["e79f3d982f0b7f7d"]
    a = spark.createDataFrame([("attention", "bf16", 1, 24, 4608, 4608, 128, False)],
                              "category string, dtype string, p_b long, p_h long, p_s_q long, p_s_kv long, p_d long, p_causal boolean")
    assert sigs(a) == ["9d2cf8e8d0555b60"]
    assert a.select(keys.describe(a)).first()[0] == "attention[bf16](b=1,causal=False,d=128,h=24,s_kv=4608,s_q=4608)"


def test_types_do_not_change_the_signature(spark):
    ints = spark.createDataFrame([("gemm", "bf16", 4608, 9216, 3072, True)], "category string, dtype string, p_m long, p_n int, p_k long, p_bias boolean")
    loose = spark.createDataFrame([("gemm", "bf16", 4608.0, 9216, 3072.0, "True")], "category string, dtype string, p_m double, p_n long, p_k double, p_bias string")
    assert sigs(ints) == sigs(loose)


def test_false_is_not_zero_and_nulls_are_absent(spark):
    f = spark.createDataFrame([("attention", "bf16", False)], "category string, dtype string, p_causal boolean")
    z = spark.createDataFrame([("attention", "bf16", 0)], "category string, dtype string, p_causal int")
    assert sigs(f) != sigs(z)
    wide = spark.createDataFrame([("attention", "bf16", False, None)], "category string, dtype string, p_causal boolean, p_m long")
    assert sigs(wide) == sigs(f)


def test_map_form_hashes_alike_and_round_trips(spark):
    df = spark.createDataFrame([("norm", "bf16", 10, 20, "rms", None)], "category string, dtype string, p_rows long, p_dim long, p_kind string, p_affine boolean")
    m = keys.params_to_map(df)
    assert m.first()["params"] == {"rows": "10", "dim": "20", "kind": '"rms"'}
    assert m.select(keys.signature_of_map(F.col("category"), F.col("dtype"), F.col("params"))).first()[0] == sigs(df)[0]
    back = keys.params_to_columns(m, ["rows", "dim", "kind", "affine"]).first()
    assert (back["p_rows"], back["p_dim"], back["p_kind"], back["p_affine"]) == (10, 20, "rms", None)


def test_text_that_needs_escaping_is_refused(spark):
    df = spark.createDataFrame([("norm", "bf16", 'a"b')], "category string, dtype string, p_kind string")
    with pytest.raises(Exception, match="needs escaping"):
        sigs(df)
