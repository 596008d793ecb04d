import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ballast.llm import toxicity
from ballast.llm.decontaminate import plain_words
from ballast.llm.queries import _tokenizer
from tests.llm import test_decontaminate, test_near_dup, test_repeats

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    model = toxicity.learn(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, SF)
        if name == "packing":
            break
        assert out.columns == columns
        out = out.persist()
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "toxicity":
            assert set(after) == {i for i, t in before.items() if brute_score(t, model) < 0.5} and len(after) < len(before)
        if name == "near_dup":
            want = {i for i, _, _, kept in test_near_dup.brute(sorted(before.items()), 80) if kept}
            assert set(after) == want
        if name == "repeats":
            for i, n, gone, _, kept in test_repeats.brute(sorted(before.items()), 50):
                if kept or not n:
                    assert after[i].text == (kept if gone else before[i]) and after[i].n_chars == len(after[i].text)
                else:
                    assert i not in after
        if name == "benchmark":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            words = {i: set(plain_words(t)) for i, t in before.items()}
            # an item within its budget shares most of its words, so the table is only needed for documents that do
            near = {i: before[i] for i in before if any(len(set(plain_words(t)) & words[i]) * 2 >= len(set(plain_words(t))) for _, t in items)}
            assert set(before) - set(after) == {d for d, _, _ in test_decontaminate.brute(near.items(), items, 15, 1)}
        docs = out
    library, pieces, sequences = Tokenizer.from_file(_tokenizer()), {}, {}
    for r in out.collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(before)
    for i, rows in pieces.items():
        ids = [*library.encode(before[i] or "", add_special_tokens=False).ids, 2]
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in rows)
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        size = rows[-1].offset + rows[-1].length
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and (size == 4096 or size & (size - 1) == 0 and size < 4096)


def test_query_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100


def test_stages_on_odd_tables(spark):
    """Repeated rows, several texts of one doc_id, nulls in every column, clashing and extra columns, no rows at all."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "en", "s", 1), (1, base, "en", "s", 1), (2, f"head {base} tail", None, None, None), (2, "clean words", None, None, None), (None, base, None, None, None), (None, None, None, None, None), (5, None, "en", "s", 0), (6, "", "en", "s", 0), (7, "long " * 50_000, "en", "s", 9)]
    df = spark.createDataFrame([(*r, 1, "k", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _kept int, seq string, score double")
    want = {"toxicity": 9, "near_dup": 7, "repeats": 9, "benchmark": 9}
    for docs, counts in ((df, want), (df.limit(0), dict.fromkeys(want, 0))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == df.columns and out.count() == counts[name], name
        texts = {r.text for r in corpus_pipeline.STAGES[2][1](spark, docs, SF).where("doc_id = 2").collect()}
        assert texts == ({"head tail", "clean words"} if counts["toxicity"] else set())
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == (6 if counts["toxicity"] else 0)


def brute_score(text, model):
    """A text's score by splitting, dictionaries and positions, without byte buffers or machines."""
    kinds = {w: k for k, ws in (("R", toxicity.REPORTING), ("N", toxicity.NEGATIONS), ("Y", toxicity.TARGETS), ("W", toxicity.INTENT), ("H", toxicity.HARM), ("I", toxicity.INSULTS)) for w in ws}
    whole, begins = {s[:-1] for s in model.lexicon.stems if s.endswith("$")}, tuple(s for s in model.lexicon.stems if not s.endswith("$"))
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    clauses = []
    for clause in re.split("[.!?;:\n]", low):
        found = [w for w in re.split("[\x00-\x20!\"#$%&()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]+", clause) if w]
        clauses.append(["I" if w in whole or begins and w.startswith(begins) else kinds.get(w, "O") for w in found])
    arcs = brute_arcs(clauses)
    x = model.weights[-1] + sum(w * arcs.get(k, 0) for k, w in zip(toxicity.ARCS, model.weights))
    return 1 / (1 + np.exp(-x))


# --- toxicity ----------------------------------------------------------------


def score(text, model):
    return float(model.score(pa.array([text], pa.string()))[0])


def path(symbols):
    _, x, _ = toxicity.best_path(list(symbols), toxicity.GRAMMAR.start, toxicity.PRIOR[:-1])
    return "".join(k * int(n) for k, n in zip(toxicity.ARCS, x))


def test_grammar_arcs():
    assert path("OYOI") == "Ia" and path("IOY") == "Ia" and path("IOOOY") == "Ia" and path("IOOOOY") == "I"
    assert path("NOI") == "In" and path("NOOOI") == "I" and path("ROOOI") == "Iq"
    assert path("WH") == "T" and path("H") == "" and path("YNWHY") == "Tna"
    assert path("II") == "IIcr" and path("IOOOOOOOI") == "IIr"
    assert path("OOO") == "" and path("IIIII") == "IIIccrrmm"


def brute_arcs(clauses):
    """Arcs of a document's matches, each rule read off positions, without machines."""
    out, seen = Counter(), 0
    for clause in clauses:
        near = lambda i, marks, reach: any(clause[j] in marks for j in range(max(0, i - reach), i))  # noqa: E731, B023
        is_match = [s == "I" or s == "H" and near(i, "WY", 3) for i, s in enumerate(clause)]
        for i, s in enumerate(clause):
            if not is_match[i]:
                continue
            if seen == 3:
                out["m"] += 1
                continue
            denied, quoted = near(i, "N", 3), near(i, "R", 40)
            out["T" if s == "H" else "I"] += 1
            out["n"] += denied
            out["q"] += quoted
            out["a"] += near(i, "Y", 4) or "Y" in clause[i + 1 : i + 5]
            out["c"] += any(is_match[j] for j in range(max(0, i - 6), i))
            if not denied and not quoted:
                out["r"] += seen > 0
                seen += 1
    return {k: n for k, n in out.items() if n}


def test_best_paths_equal_rules_read_off_positions():
    r = random.Random(3)
    for _ in range(4000):
        clauses = [r.choices("OIHWYNR", (6, 3, 2, 1, 1.5, 1, 0.7), k=r.randrange(1, 12)) for _ in range(r.randrange(1, 4))]
        state, total = toxicity.GRAMMAR.start, Counter()
        for c in clauses:
            w, x, state = toxicity.best_path(c, state, toxicity.PRIOR[:-1])
            assert abs(w - x @ toxicity.PRIOR[:-1]) < 1e-9
            total.update({k: int(n) for k, n in zip(toxicity.ARCS, x)})
        assert {k: n for k, n in total.items() if n} == brute_arcs(clauses), clauses


def test_best_path_is_the_heaviest_of_all_paths():
    r, weights = random.Random(4), toxicity.PRIOR[:-1]

    def every(symbols, state):
        if not symbols:
            if toxicity.GRAMMAR.final(state):
                yield 0.0
            return
        for to, _, names in toxicity.GRAMMAR.arcs(state, symbols[0]):
            for w in every(symbols[1:], to):
                yield w + float(toxicity.counted(names) @ weights)

    for _ in range(300):
        clause = r.choices("OIHWYNR", k=r.randrange(1, 8))
        assert abs(max(every([*clause, "#"], toxicity.GRAMMAR.start)) - toxicity.best_path(clause, toxicity.GRAMMAR.start, weights)[0]) < 1e-9


def test_clauses_not_words():
    m = toxicity.Model([], toxicity.PRIOR)
    plain, denied, quoted = (score(t, m) for t in ("You are an idiot, a moron.", "You are not an idiot.", "He said that he was an idiot."))
    assert plain > 0.5 > denied and quoted < 0.5
    assert score("", m) == score(None, m) == score("all is well", m) < 0.1
    assert score("we will hurt them", m) > score("this may hurt", m)
    assert score("an idiot wrote the manual", m) < 0.5 < score("Idiot. That moron again, this scum.", m)


def test_lone_insult_never_decides():
    r = random.Random(5)
    x = np.array([[1 if k == "I" else 0 for k in toxicity.ARCS]] * 300 + [[0] * len(toxicity.ARCS)] * 300, float)
    w = toxicity.fit_weights(x, np.array([1.0] * 300 + [0.0] * 300))
    assert w[0] + w[-1] <= -0.5
    y = np.array([float(r.random() < 0.5) for _ in range(600)])
    assert (np.sign(toxicity.fit_weights(x, y)[:-1]) * np.sign(toxicity.PRIOR[:-1]) >= 0).all()


def test_long_texts_and_ties(spark):
    m = toxicity.Model([], toxicity.PRIOR)
    long = "word " * 300_000
    rows = [(1, long), (2, long + "You are an idiot, you moron."), (2, "fine"), (2, "fine"), (None, "Idiot. Moron. Scum."), (4, None)]
    df = spark.createDataFrame([(i, t, 1.0, "x", 0) for i, t in rows], "doc_id long, text string, score double, symbols string, made int")
    kept = toxicity.drop_toxic(spark, df, m)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == [(1, len(long)), (2, 4), (2, 4), (4, 0)]
    assert sum(r.score >= 0.5 for r in toxicity.score_documents(spark, df, m).collect()) == 2


def test_learned_stems_and_held_out(spark):
    r = random.Random(0)
    vocab = ["".join(r.choices("abcdefg", k=5)) for _ in range(300)]
    rows = []
    for i in range(1200):
        w, toxic = r.choices(vocab, k=40), i % 6 == 0
        if toxic:
            for at in r.sample(range(40), 3):
                w[at] = "zorg" + "".join(r.choices("abcdefgh", k=3))
        rows.append((i, " ".join(w) if i % 100 else None, "x", int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    m = toxicity.learn(spark, df, df, train)
    assert m.lexicon.stems == ["zorg"]
    got = {x.doc_id: x.score for x in toxicity.score_documents(spark, df, m).collect()}
    held = [(i, t, y) for i, t, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0 and t]
    assert len(held) > 100 and all((got[i] >= 0.5) == bool(y) for i, t, y in held)
    kept = toxicity.drop_toxic(spark, df, m)
    assert kept.columns == df.columns and kept.count() == sum(s < 0.5 for s in got.values())
    none = toxicity.learn(spark, df, df.limit(0), train)
    assert none.lexicon.stems == [] and (none.weights == toxicity.PRIOR).all()
    assert toxicity.score_documents(spark, df.limit(0), none).count() == 0
