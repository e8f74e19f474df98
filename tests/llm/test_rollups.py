from pyspark.sql import functions as F

from crivo.llm.rollups import Rollup, changes

from . import edge


def totals(rollup):
    return sorted((tuple(r) for r in rollup.totals().collect()), key=repr)


def test_batches_apply_once_in_any_order(spark, tmp_path):
    docs = edge.docs(spark)
    size = F.length("text")
    batches = {
        "a": changes(docs, "insert", "v1", size),
        "b": changes(docs.where("doc_id = 2"), "delete", "v1", was=size),
        "c": changes(docs.where("lang = 'de'"), "revise", "v1", size + 5, size),
    }
    first, second = Rollup(spark, f"{tmp_path}/1"), Rollup(spark, f"{tmp_path}/2")
    assert totals(first) == []
    for name in "abc":
        assert first.commit(name, batches[name])
        assert not first.commit(name, batches[name])
    for name in "cba":
        second.commit(name, batches[name])
    second.compact()
    assert not second.commit("b", batches["b"]) and second.batches() == {"a", "b", "c"}
    assert totals(first) == totals(second)
    want = {}
    for doc_id, text, lang, source, *_ in edge.ROWS:
        n, t = want.get((source, lang), (0, 0))
        gone = doc_id == 2
        want[source, lang] = (n + (not gone), t + (0 if gone else len(text or "")) + (5 if lang == "de" and text is not None else 0))
    assert {(s, g): (n, t) for s, g, _, n, t in totals(first)} == want
    second.commit("d", changes(docs, "delete", "v1", was=size))
    second.compact()
    assert second.batches() == {"a", "b", "c", "d"} and sum(r[3] for r in totals(second)) == -2


def test_empty(spark, tmp_path):
    rollup = Rollup(spark, f"{tmp_path}/r")
    assert rollup.commit("none", changes(edge.empty(spark), "insert", "v", F.length("text")))
    assert totals(rollup) == []


def test_the_slower_of_two_committers_changes_nothing(spark, tmp_path):
    """Both have seen that the batch is not there; the rename tells them apart."""
    one, two = Rollup(spark, f"{tmp_path}/r"), Rollup(spark, f"{tmp_path}/r")
    batch = changes(edge.docs(spark), "insert", "v1", F.length("text"))
    from crivo.llm.rollups import signed

    assert one._publish(signed(batch), "deltas/x") and not two._publish(signed(batch), "deltas/x")
    assert sum(r[3] for r in totals(one)) == len(edge.ROWS) and not two.commit("x", batch)
