"""Property rules and beginnings of Thai sentences counted in the corpus."""

from lectern.llm import sentences


def _cut(text, *more):
    return [text[a:b] for a, b in sentences.units(text, *more)]


def test_property_rules():
    assert _cut("It cost 3.4 and U.S.A law held. Then, it fell; no: not so. Done") == ["It cost 3.4 and U.S.A law held.", "Then, it fell; no: not so.", "Done"]
    assert _cut("He left. ...and then silence. Why?! No.") == ["He left.", "...and then silence.", "Why?!", "No."]
    assert _cut("Տեսար։ Այո։ ምን ሆነ? አለ። እሺ።") == ["Տեսար։", "Այո։", "ምን ሆነ?", "አለ።", "እሺ።"]
    assert _cut("One‼ Two⁈ Three") == ["One‼", "Two⁈", "Three"]


def test_thai_beginnings_are_counted(spark):
    texts = [(i, "ปลา Tuna ว่ายน้ำ มานี เดินไปตลาด") for i in range(30)] + [(90, "แมว Tom นอน ปลา Shark ว่ายน้ำ"), (91, None), (92, "no Thai")]
    df = spark.createDataFrame(texts, "id long, text string")
    openers = sentences.thai_openers(df, "text")
    assert "ปลา" in openers and "มาน" in openers and "ว่า" not in openers
    assert _cut("ดู Tom ปลา Shark ว่ายน้ำ", openers) == ["ดู Tom", "ปลา Shark ว่ายน้ำ"]
    assert sentences.sentence_units(df.where("id = 92")).count() == 1 and sentences.sentence_units(df.limit(0)).count() == 0
