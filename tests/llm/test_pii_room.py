import re
import string

from siftline.llm.pii import pseudonymise


def test_formats_without_room(spark):
    """Values without a letter or digit are no secrets; where all values of a format are taken, surrogates are longer."""
    text = "Password:__________ pwd=////// | token:------ | " + " ".join(f"token=-----{c}" for c in string.ascii_lowercase)
    text += "; " + " ".join(f"+1 {k // 100:02d} {k % 100:02d}" for k in range(0, 10000, 1))
    r = pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").collect()[0]
    assert r.text.startswith("Password:__________ pwd=////// | token:------ | ")
    assert r.n_entities == 26 + 10000
    tokens, phones = r.text.split("; ")
    tokens = re.findall(r"token=(-----[a-z]{2,})", tokens)
    assert len(set(tokens)) == 26
    phones = re.findall(r"\+1 \d\d \d{3,}", phones)
    assert len(set(phones)) == 10000
