"""Tokens in runs that hold marks of two alphabets, such as paths of URLs."""

import random

from tabloom.llm import secrets

from .conftest import frame

URL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def test_tokens_after_a_path(spark):
    rng = random.Random(12)

    def token():
        return rng.choice("abc") + "".join(rng.choice(URL) for _ in range(40)) + "-7_q"

    starts = ("/reset/", "services/v1/", "https://a-b.example/user_pages/long/way2/here/", "my-app/x/")
    texts = [f"see {start}{token()}{end} now" for start in starts for end in ("", "/edit") for _ in range(10)]
    plain = ["/usr/share/doc-base/some_words_of_a_path/a1/more-words/and/again-words/b2", "é " + "-".join(["ab1/cd"] * 9)]
    found = secrets.find_secrets(frame(spark, texts + plain)).select("doc_id", "text", "_spans").collect()
    for r in found:
        if r.doc_id < len(texts):
            start = max(r.text.find(s) + len(s) for s in starts if s in r.text)
            assert (start, start + 45) in {(s.start, s.end) for s in r._spans}, r.text


def test_pieces_and_their_places(spark):
    a, b = "Ab1" * 10, "cD2" * 10
    text = f"é {a}-x/{b}_y+{a}/zz, {a}/{b} {a}-{b}"
    rows = frame(spark, [text]).select(secrets._tokens(secrets.F.col("text")).alias("t")).collect()[0].t
    assert all(text[t.start : t.end] == t.token for t in rows)
    assert sorted(t.token for t in rows) == sorted([f"{a}-x", f"{b}_y", a, a, f"x/{b}", f"y+{a}/zz", f"{a}/{b}", f"{a}-{b}"])
