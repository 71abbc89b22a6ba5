"""Quality rules against plain counting, and on edge cases."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from bourselight.llm.quality_rules import RULES, Rule, judge
from bourselight.llm.queries import OP5_SQL, op5
from tests.llm.helpers import FOLDER, docs_of, stored, words
from tests.oracle import compare, connect

PROSE = "the story of a man who was in the house and of his dog that came to it with all of the things for " * 1
EDGE = [None, "", " \n\t", "one", PROSE * 3, PROSE + " ".join(f"word{k} of the" for k in range(90)), "a b c a b c", "a a a a a", "x\n\nx\n x\nx \n",
        "é 文 𝒳 #$% & <b>|\x0bz\x0cz\rz", "nbsp word", "- item\n" * 60, " ".join(f"w{k}" for k in range(30_000)), "a b c d " * 9000, "tail ..." * 60]


def plain(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("extra", ["", "row f kept base_failed n_words"])
def test_measures(spark, tmp_path, extra):
    rows = list(enumerate(EDGE)) + [(3, "one")]
    out = judge(stored(docs_of(spark, rows, extra), tmp_path)).select("row.doc_id", "f.*", "base_failed", "kept").collect()
    assert len(out) == len(rows)
    for r in out:
        want = plain(EDGE[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, EDGE[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in out if r.kept}
    assert 5 in kept and not kept & {0, 1, 2, 3, 4, 11, 13}


def test_the_table_is_compiled(spark, tmp_path):
    docs = stored(docs_of(spark, [(1, EDGE[5])]), tmp_path)
    assert judge(docs).first().kept
    assert not judge(docs, rules=(Rule("n_words", None, None, 60),)).first().kept
    assert not judge(docs, rules=(Rule("n_stop_words", "n_words", 0.99, None),)).first().kept
    assert judge(stored(docs_of(spark, []), tmp_path / "e"), rules=RULES).count() == 0


def test_query(spark):
    assert compare(op5, OP5_SQL, spark, connect(FOLDER), FOLDER)[0] == "ok"


def test_one_projection(spark):
    plan = op5(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow", "Join"))
