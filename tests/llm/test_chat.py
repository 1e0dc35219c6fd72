from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tivlens.llm import chat

NODES = "tree long, node long, parent long, score double, role string, text string, up string"


def formatted(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], NODES)
    return chat.format_trees(df, **options)


def test_best_branches(spark):
    rows = [(1, 1, None, 0.0, "user", "root"), (1, 2, 1, 5.0, "assistant", "a"), (1, 3, 1, 1.0, "assistant", "b"),
            (1, 4, 3, 9.0, "user", "c"), (1, 5, 3, 9.0, "user", None), (2, 1, None, None, None, "alone"),
            (3, 1, 2, 1.0, "user", "x"), (3, 2, 1, 1.0, "user", "cycle"), (3, 3, 2, 1.0, "user", "tail"),
            (4, 7, 99, 1.0, "user", "parent is missing")]
    got = formatted(spark, rows, top_k=2).select(
        "tree", "leaf", "score", "rank", "n_turns", chat.parse(F.col("formatted")).alias("turns"), chat.learned_text()).collect()
    found = {(r.tree, r.rank): (r.leaf, r.score, r.n_turns, [tuple(t) for t in r.turns], r[6]) for r in got}
    assert found == {
        (1, 1): (4, 10.0, 3, [("user", "root"), ("assistant", "b"), ("user", "c")], "b"),
        (1, 2): (5, 10.0, 3, [("user", "root"), ("assistant", "b"), ("user", "")], "b"),
        (2, 1): (1, 0.0, 1, [("", "alone")], ""), (4, 1): (7, 1.0, 1, [("user", "parent is missing")], "")}


def test_deep_chain_and_empty_table(spark):
    rows = [(1, k, k - 1 if k else None, 1.0, "assistant", str(k)) for k in range(300)]
    got = formatted(spark, rows).select("n_turns", chat.learned_text().alias("said")).first()
    assert (got.n_turns, got.said) == (300, "".join(map(str, range(300))))
    assert formatted(spark, []).count() == 0


def test_repeated_turns_are_ordered(spark):
    turns = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None)],
                                  "conv_id long, turn long, role string, text string")
    got = chat.format_trees(chat.chains(turns)).select(chat.parse(F.col("formatted")).alias("turns")).first()
    assert [t.text for t in got.turns] == ["", "a", "a", "b"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["assistant", "user", "a\nb\\e<", ""]), st.text("\\<>/turneblassi \n\r", max_size=30)),
                min_size=30, max_size=30))
def test_round_trip(spark, turns):
    rows = [(k, 0, None, 0.0, role, text) for k, (role, text) in enumerate(turns)]
    got = formatted(spark, rows).select("tree", chat.parse(F.col("formatted")).alias("turns"), chat.learned_text().alias("said")).collect()
    assert {r.tree: tuple(r.turns[0]) for r in got} == dict(enumerate(turns))
    assert {r.tree: r.said for r in got} == {k: t if role == "assistant" else "" for k, (role, t) in enumerate(turns)}


def test_native_plan(spark):
    plan = formatted(spark, [(1, 1, None, 0.0, "user", "x")])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_null_trees(spark):
    rows = [(None, 1, None, 0.0, "user", "root"), (None, 2, 1, 1.0, "assistant", "a"), (None, 3, 2, 1.0, "user", "b"),
            (None, 4, 1, 1.5, "user", "c"), (0, 1, None, 0.0, "user", "zero")]
    got = formatted(spark, rows, top_k=2).select("tree", "rank", "leaf", "n_turns", chat.learned_text().alias("said")).collect()
    assert {tuple(r) for r in got} == {(None, 1, 3, 3, "a"), (None, 2, 4, 2, ""), (0, 1, 1, 1, "")}
    assert {(r.tree, r.leaf) for r in chat.paths(spark.createDataFrame([(*r, "x") for r in rows], NODES)).collect()} == {
        (None, 3), (None, 4), (0, 1)}
    turns = spark.createDataFrame([(None, 0, "user", "x"), (None, 1, "assistant", "y"), (5, 0, "user", "z")],
                                  "conv_id long, turn long, role string, text string")
    assert {(r.tree, r.n_turns) for r in chat.format_trees(chat.chains(turns)).collect()} == {(None, 2), (5, 1)}
