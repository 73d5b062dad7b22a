"""Rare languages among large ones."""

from lexspark.llm import language


def test_rare_languages_are_learned(spark):
    rows = [(i, f"ababa babab {i}", "big") for i in range(4000)] + [(5000 + i, f"xyzzy zyxxy {i}", "rare") for i in range(6)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), max_train=100)
    assert model.languages == ["big", "rare"]
    assert model.scores(["zyxxy xyzzy"])[0] == ["rare"]
    assert language._quota([5, 50, 50], 45) == 20 and language._quota([5, 6], 45) > 6
