from collections import Counter

import pyarrow as pa
import pytest

from quire.llm import op02_quality as Q
from quire.llm import words as W


def counted(text):
    words, lines = text.split(), [x for x in text.split("\n") if x.split()]
    windows = Counter(tuple(words[k: k + 5]) for k in range(len(words) - 4))
    covered = {x for k in range(len(words) - 4) if windows[tuple(words[k: k + 5])] > 1 for x in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


PROSE = "The river ran slowly past the old mill and nobody spoke of it again. "
TEXTS = [
    None, "", "  \n\t\n", "one two three", PROSE, PROSE * 4, PROSE + "\n" + "Home | News | About | Help\n" * 2, "é # « x » | y\n" * 3 + PROSE,
    "A B " * 40, "word " * 5000, "x" * 40_000,
]


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_counts(docs, rows_of, monkeypatch, block):
    monkeypatch.setattr(W, "BLOCK", block)
    found = rows_of(Q.quality(docs(TEXTS).withColumnRenamed("source", "kept")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for k, text in enumerate(TEXTS):
        assert tuple(found[k][n] for n in names) == counted(text or ""), text and text[:60]
        assert found[k]["base_failed"] == (found[k]["n_words"] < 10 or 100 * found[k]["n_repeat_words"] > 20 * found[k]["n_words"])


def passed(line):
    words, offsets = W.texts(pa.array([line]))
    return bool(Q.judge(W.split(words, offsets), offsets)[2][0])


@pytest.mark.parametrize("line, good", [
    (PROSE, True), ("Short but closed.", True), ("Short and open", False), ("eight words and more may stand without mark here", True),
    ("Home | News | About us", False), ("Some of it is » set apart", False), ("EVERYTHING IS SHOUTED HERE TODAY, IT IS.", False), ("IBM.", True),
    ("a*** b$$$ c### d&&& e f g h i", False), ("The foundation said: All Rights Reserved.", False), ("He said “yes”", True), ("And so on…", True),
])
def test_lines(line, good):
    assert passed(line) is good


def test_documents_that_lose_too_much_go(docs, rows_of):
    menu = "Home | News | About | Help | Contact | Search\n"
    found = rows_of(Q.quality(docs([PROSE + "\n" + menu, PROSE + "\n" + menu * 1 + "Other | Words | Stand | In | This | Menu | Of | Links\n", menu + PROSE])))
    assert [found[k]["kept"] for k in range(3)] == [True, False, True]
    assert found[0]["clean_text"] == PROSE + "\n" and found[2]["clean_text"] == PROSE


def test_rows(docs):
    same = Q.quality(docs([(None, PROSE), (1, PROSE), (1, PROSE)])).collect()
    assert len(same) == 3 and all(r["kept"] for r in same)
    assert Q.quality(docs([])).count() == 0
