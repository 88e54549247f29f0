"""The document parser gets whole turns."""

from tierloom.plans.relation_queries import parse_documents


def test_text_after_the_first_characters_is_parsed(spark, tmp_path):
    turn = "abcdefghijklmn＋猫の形をした山(fal)"
    spark.createDataFrame([(1, 1, "user", turn)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = parse_documents(spark, str(tmp_path)).first().asDict()
    assert any("山" in str(v) for k, v in got.items() if k not in ("conv_id", "turn", "role"))
