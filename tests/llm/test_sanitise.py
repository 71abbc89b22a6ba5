"""Base spans against Python's own engine, and terms that reveal an entity."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from bourselight.llm.queries import op9
from bourselight.llm.sanitise import joined, sanitise
from tests.llm.helpers import FOLDER, docs_of, documents, stored

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def fits(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
        "card": 16 <= len(digits) <= 19 and luhn(digits),
        "phone": 8 <= len(digits) <= 15,
    }[kind]


def brute(text: str | None) -> list[str]:
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in p.finditer(text or "") if fits(k, m.group())]


EDGE = [
    None, "", "a@b.c_x@d.e-f.g@h", "x@y", "é a.b%c+d-e@f-1.g.h.", "..@a.b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.001.2.3 99999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111 1111 1112", "41111111111111111111111", "4111  1111111111111111", "7 4111111111111111",
    "+1 (743) 555-3824", "+1((((((", "+12345678901234567890 5", "+1 2", "++49 30 1234567-89)", "1" * 30_000, "a" * 50_000, "+" * 3000, "1.2.3.4@a.b",
    "𝒳 𝒳 mail 𝒳@q.example.com", "+4111111111111111",
]


@pytest.mark.parametrize("extra", ["", "base spans clean removed row body"])
def test_base_spans(spark, tmp_path, extra):
    rows = list(enumerate(EDGE)) + [(2, EDGE[2])]
    out = sanitise(stored(docs_of(spark, rows, extra), tmp_path)).select("row.doc_id", joined("base_list").alias("b"), "clean").collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.b.split(",") == (brute(EDGE[r.doc_id]) or [""]), EDGE[r.doc_id]
        assert not (brute(EDGE[r.doc_id]) and r.clean == EDGE[r.doc_id])
        if not brute(EDGE[r.doc_id]):
            assert r.clean == (EDGE[r.doc_id] or "")


def test_addresses_with_zero_parts(spark, tmp_path):
    texts = ["0.0.0.0", "10.0.0.1 127.0.0.1", "1.00.2.3 000.000.000.000 192.168.0.1", "0256.0.0.0 1.0.0.256 " + "0" * 4_000 + "9999.0.0.1", "0" * 4_000 + ".0.0.7"]
    out = sanitise(stored(docs_of(spark, list(enumerate(texts))), tmp_path)).select("row.doc_id", joined("base_list").alias("b"), "clean").collect()
    assert {r.doc_id: r.b.split(",") for r in out} == {k: brute(t) or [""] for k, t in enumerate(texts)}
    assert {r.clean for r in out if r.doc_id < 3} == {"[IP]", "[IP] [IP]", "[IP] [IP] [IP]"}


def test_redaction(spark, tmp_path):
    docs = stored(docs_of(spark, [(1, "Mail a@b.c or +1 743 555 3824, card +4111111111111111 ok")]), tmp_path)
    assert sanitise(docs).first().clean == "Mail [EMAIL] or [PHONE], card +[CARD] ok"


def test_revealing_terms(spark, tmp_path):
    letters = "bcdfghjklmnpqrstvwxz"
    filler = lambda k: "alpha beta " + " ".join(f"{letters[k % 20]}{letters[k // 20]}a{letters[j]}u" for j in range(20))
    rows = [(k, f"{filler(k)} zebulon lives near, write to z@corp.example") for k in range(6)]
    rows += [(k, f"{filler(k)} and nothing else lives near, write") for k in range(6, 60)]
    rows += [(60, "zebulon without any address")]
    rows += [(70 + k, "xylophone copied copied q@one.example") for k in range(9)]
    out = {r.doc_id: r for r in sanitise(stored(docs_of(spark, rows), tmp_path)).select("row.doc_id", "row.text", "clean", joined("spans").alias("s")).collect()}
    for k in range(6):
        assert "zebulon" not in out[k].clean and "z@corp" not in out[k].clean and "alpha beta" in out[k].clean
        at = out[k].text.index("zebulon")
        assert f"term:{at}:{at + 7}" in out[k].s.split(",")
    assert out[7].clean == out[7].text and out[60].clean == out[60].text
    assert out[70].clean == "xylophone copied copied [EMAIL]"


def test_revealing_term_of_a_frequent_entity(spark, tmp_path):
    rng = random.Random(3)
    syllables = [a + b for a in "bcdfghjklmnprstvwz" for b in "aeiou"]
    vocabulary = ["".join(rng.choices(syllables, k=3)) for _ in range(4000)]
    frequent = ["one", "two", "six", "ten"]
    text = lambda: " ".join(rng.sample(vocabulary, 12) + frequent)
    rows = [(k, f"{text()} zebulon z@corp.example") for k in range(400)] + [(k, text()) for k in range(400, 4000)]
    rows += [(4000 + k, f"{rows[0][1]}") for k in range(300)] + [(5000 + k, rows[700][1]) for k in range(300)]
    out = sanitise(stored(docs_of(spark, rows), tmp_path)).select("row.doc_id", "row.text", "clean").collect()
    for r in out:
        if r.doc_id < 400 or 4000 <= r.doc_id < 5000:
            assert "zebulon" not in r.clean and "[TERM]" not in r.clean and r.clean.count("one two six ten") == 1
        else:
            assert r.clean == r.text


def test_terms_that_reveal_a_shared_part(spark, tmp_path):
    letters = "bcdfghjklmnpqrstvwxz"
    filler = lambda k: "alpha beta " + " ".join(f"{letters[k % 20]}{letters[k // 20]}a{letters[j]}u" for j in range(20))
    rows = [(k, f"{filler(k)} zebulon person{k}@corp.example") for k in range(6)]
    rows += [(k, f"{filler(k)} quixotic +1 743 555 10{k}") for k in range(10, 16)]
    rows += [(k, f"{filler(k)} nothing") for k in range(20, 80)]
    out = {r.doc_id: r.clean for r in sanitise(stored(docs_of(spark, rows), tmp_path)).select("row.doc_id", "clean").collect()}
    assert all("zebulon" not in out[k] and "alpha beta" in out[k] and "[EMAIL]" in out[k] for k in range(6))
    assert all("quixotic" not in out[k] and "alpha beta" in out[k] and "[PHONE]" in out[k] for k in range(10, 16))
    assert all(out[k] == dict(rows)[k] for k in range(20, 80))


def test_empty(spark, tmp_path):
    assert sanitise(stored(docs_of(spark, []), tmp_path)).count() == 0


def test_query(spark):
    texts = {d["doc_id"]: d["text"] for d in documents()}
    for r in op9(spark, FOLDER).collect():
        spans = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in BASE]
        assert r.spans.split(",")[: len(spans) or 1] == (spans or [""])


def test_no_python_in_the_plan(spark):
    plan = op9(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
