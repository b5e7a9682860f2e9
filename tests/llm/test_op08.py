import pytest

from quire.llm import op08_decontaminate as D

ITEM = "What is the Capital of France, asked 12 pupils in 1990"
SHORT = "Étude no. 5"


@pytest.fixture
def items(spark):
    rows = [(7, ITEM), (10, ITEM + " or so"), (7, ITEM), (2, SHORT), (3, None), (4, " ?! "), (None, "Null item of four")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


TEXTS = [
    "so: what-is the capital OF france asked (12) pupils in 1990!", "what is the capital of france asked 12 pupils in", "étude No... 5 étude no 5",
    "Étude no 5 Étude no 5", "éTUDE no 5", None, "", "?", "null item of four " + "w " * 30_000, (ITEM + " or so. ") * 3,
]


@pytest.mark.parametrize("set_bytes", [D.SET_BYTES, 200])
def test_marks(docs, items, rows_of, set_bytes):
    found = rows_of(D.mark(docs(TEXTS).withColumnRenamed("source", "n_hit"), items, set_bytes=set_bytes))
    short = lambda k: (found[k]["n_hit"], found[k]["item_ids"], found[k]["n_items"], found[k]["contaminated"])
    assert short(0) == (11, ["10", "7"], 2, True)
    assert short(1) == (10, ["10", "7"], 2, True)
    assert short(2) == (0, [], 0, False) and short(4) == (0, [], 0, False)  # other letters beyond ASCII are other words
    assert short(3) == (6, ["2"], 1, True)
    assert [found[k]["n_words"] for k in (5, 6, 7)] == [0, 0, 0]
    assert short(8) == (4, [], 0, True)
    assert found[9]["n_words"] == found[9]["n_hit"] == 39 and found[9]["n_items"] == 2


def test_removal(docs, items):
    left = D.decontaminate(docs(TEXTS), items)
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 4, 5, 6, 7]
    cut = {r["doc_id"]: r["text"] for r in D.decontaminate(docs(["before. " + ITEM + " after it", *TEXTS[3:6], "so " + TEXTS[0]]), items, remove="spans").collect()}
    assert cut == {0: "before. after it", 1: "", 2: TEXTS[4], 3: None, 4: "so so: "}


def test_rows(docs, items, spark):
    same = D.mark(docs([(None, TEXTS[0]), (1, TEXTS[0]), (1, TEXTS[0])]), items).collect()
    assert len(same) == 3 and all(r["n_hit"] == 11 for r in same)
    assert D.mark(docs([]), items).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r["n_hit"] for r in D.mark(docs(TEXTS), none).collect()] == [0] * len(TEXTS)
    assert D.decontaminate(docs(TEXTS), none).count() == len(TEXTS)


def test_plan_has_no_python(docs, items):
    plan = D.mark(docs(TEXTS), items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
