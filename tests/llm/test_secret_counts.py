"""Owners and repositories decide together which secrets look live."""

from tierloom.llm import secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_both_counts_decide(spark):
    hot, two, wide, lone = "password=example12345", "password=livelive12345", "Zx9Kq2Lm8Tr4Vb6Nn1Pd", "Aa0Bb1Cc2Dd3Ee4Ff5Gg6"
    texts = [(i, f"{hot} x {wide} {i}", "one") for i in range(12)] + [(20, two, "a"), (21, two, "b"), (22, lone, "a"), (23, lone, "a")]
    texts += [(30 + i, "token=spreadspread1", f"s{i}") for i in range(3)] + [(40, None, "a")]
    frame = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in texts], SCHEMA)
    got = {r["doc_id"]: r for r in secrets.find_secrets(frame).collect()}
    assert got[3]["spans"] == "assign:0:21" and got[3]["span_counts"] == "1:12" and (got[3]["n_live"], got[3]["n_copied"]) == (0, 1)
    assert got[20]["spans"] == "assign:0:22" and got[20]["span_counts"] == "2:2" and (got[20]["n_live"], got[20]["n_copied"]) == (1, 0)
    assert got[22]["spans"] == "owned:0:21" and got[22]["span_counts"] == "1:2" and (got[30]["span_counts"], got[30]["n_live"]) == ("3:3", 0)
    assert got[40]["spans"] == got[40]["span_counts"] == ""
    left = {r["doc_id"]: r["text"] for r in secrets.redact_live_secrets(frame).collect()}
    assert left[3] == texts[3][1] and left[20] == left[21] == left[22] == "[SECRET]" and left[30] == "token=spreadspread1"
