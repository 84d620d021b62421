"""The pipeline against brute force on the smallest table."""

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tideloom.llm import common, language

from .test_neardup import brute as near_groups


def cut(rows, least=50):
    smallest = {}
    for d, t in rows:
        raw = t.encode()
        for i in range(len(raw) - least + 1):
            smallest[raw[i : i + least]] = min(smallest.get(raw[i : i + least], d), d)
    out = {}
    for d, t in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - least + 1):
            if smallest[raw[i : i + least]] < d:
                gone[i : i + least] = b"\1" * least
        out[d] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore") if any(gone) else t
    return out


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = {r["doc_id"]: r for r in language.language_id(docs).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if judged[r["doc_id"]]["lang_pred"] != "und" and judged[r["doc_id"]]["score"] >= 0.02}
    last = {}
    for d, t in rows.items():
        last[t] = max(last.get(t, d), d)
    rows = {d: t for t, d in last.items()}
    groups = near_groups(list(rows.items()), 5, 80)
    rows = {d: t for d, t in rows.items() if groups[d][1] == d}
    texts = cut(list(rows.items()))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    out = corpus_pipeline.run(spark, sf).collect()
    found = {}
    for r in out:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] == lengths[r["doc_id"]]
    assert found == lengths


def python_steps_side_by_side(plan):
    """Python steps of a plan (printed as a tree) that take what another one gives, with no exchange between."""
    above, found = [], []
    for line in plan.splitlines():
        depth = next((i for i, c in enumerate(line) if c.isalpha() or c == "("), 0)
        above = [x for x in above if x[0] < depth]
        if "MapInArrow" in line:
            nearest = next((kind for _, kind in reversed(above) if kind), "")
            found += [line] if nearest == "python" else []
        above.append((depth, "python" if "MapInArrow" in line else "exchange" if "Exchange" in line else ""))
    return found


def test_a_task_needs_one_python_worker(spark, monkeypatch):
    plans = {}
    stored = common.stored

    def noted(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, tag)

    monkeypatch.setattr(common, "stored", noted)
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" in plans["neardup-texts"]
    assert {tag: found for tag, plan in plans.items() if (found := python_steps_side_by_side(plan))} == {}
