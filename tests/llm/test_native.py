import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.llm._shared import Scratch
from ballast.llm import chat, quality, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


# --- chat -------------------------------------------------------------------

ODD = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "\\<|text|>", "<|turn new|>assistant<|text|>x<|end|>", "", None, "é\n\\\\<|", "plain text, with words.", "<", "|>", "<|" * 3, "\\"]


def conversations(seed=0):
    r = random.Random(seed)
    rows = []
    for c in range(12):
        turn = 0
        if r.random() < 0.5:
            rows.append((c, turn, "system", r.choice(ODD)))
            turn += 1
        for _ in range(r.randrange(1, 40)):
            rows.append((c, turn, r.choice(("user", "assistant", "assistant", "<|tool|>")), r.choice(ODD + ["word " * r.randrange(60)])))
            turn += r.choice((1, 1, 3))
    rows += [(None, 0, "user", "no id"), (99, None, None, "first"), (99, 1, "assistant", "same"), (99, 1, "assistant", "same"), (100, 0, "assistant", "long " * 5000)]
    return rows


def ordered(rows):
    by = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    return by


@pytest.mark.parametrize("budget, history", [(1024, 256), (40, 20), (12, 0)])
def test_windows_read_back(spark, budget, history):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string")
    made = chat.format_conversations(df, budget, history)
    assert no_python(made) and no_python(chat.read_back(made))
    turns, targets, tokens = {}, {}, {}
    back = {(r.conv_id, r.window): r for r in chat.read_back(made).collect()}
    for r in sorted(made.collect(), key=lambda r: (str(r.conv_id), r.window)):
        b = back[r.conv_id, r.window]
        assert len(b.turns) == r.n_turns > 0
        turns.setdefault(r.conv_id, []).extend((x.role, x.text) for x in b.turns)
        targets.setdefault(r.conv_id, []).extend(b.targets)
        assert r.n_tokens <= budget or (r.n_turns == 1 and r.text.count(chat.OLD) <= 1)
    want = ordered(rows)
    assert turns == want
    assert targets == {c: [t for role, t in x if role == "assistant"] for c, x in want.items()}
    if budget == 40:
        texts = [r for r in made.where("conv_id = 3").collect()]
        assert any(chat.OLD in r.text for r in texts)


def test_budget_holds(spark):
    """Windows of random turns: within the budget, but for one turn that does not fit beside the system turn, and none needlessly small."""
    r = random.Random(8)
    rows, size = [], {}
    for c in range(60):
        system = r.choice((0, 0, 5, 200, 604, 900, 1100))
        sizes = [("system", system)] * (system > 0) + [(r.choice(("user", "assistant", "assistant", "system")), r.choice((1, 16, 16, 40, 300, 700, 1500, r.randrange(1, 500)))) for _ in range(r.randrange(1, 60))]
        if c == 0:
            sizes = [("system", 600)] + [("user", 16)] * 38 + [("assistant", 696)] + [("user", 16)] * 9
        rows += [(c, i, role, "w " * n) for i, (role, n) in enumerate(sizes)]
        size[c] = sizes
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 1024, 256).orderBy("conv_id", "window").collect()
    by = {}
    for w in made:
        by.setdefault(w.conv_id, []).append(w)
    for c, ws in by.items():
        sizes, at = size[c], 0
        first = next((i for i, (role, _) in enumerate(sizes) if role == "system"), None)
        new = []
        for w in ws:
            own = [n + 4 for _, n in sizes[at : at + w.n_turns]]
            new.append(sum(own))
            kept = sizes[first][1] + 4 if first is not None and first < at else 0
            olds = w.text.count(chat.OLD) - (kept > 0)
            back = [sizes[i][1] + 4 for i in range(at - 1, -1, -1)]
            # repeated turns are the nearest ones, as many as fit
            room, seen, used, total = max(0, min(256, 1024 - kept - sum(own))), 0, 0, 0
            for i, n in zip(range(at - 1, -1, -1), back):
                used += n
                if used > room:
                    break
                if i != first:
                    seen, total = seen + 1, total + n
            assert (olds, w.n_tokens) == (seen, sum(own) + kept + total)
            assert w.n_tokens <= 1024 or (w.n_turns == 1 and olds == 0)
            at += w.n_turns
        assert at == len(sizes)
        # at most every other window could have taken its neighbour whole
        assert len(ws) <= 4 + 4 * sum(min(n + 4, 1024) for _, n in sizes) / max(64, 768 - (sizes[first][1] + 4 if first is not None else 0)) + 2 * sum(2 * (n + 4) > 768 - (sizes[first][1] + 4 if first is not None else 0) for _, n in sizes)


def test_system_turn_is_retained_and_history_is_bounded(spark):
    rows = [(1, 0, "system", "rules")] + [(1, i, "user" if i % 2 else "assistant", f"t{i} a b c d e") for i in range(1, 30)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 60, 24).orderBy("window").collect()
    assert len(made) > 3
    for r in made[1:]:
        assert r.text.startswith(f"{chat.HEAD}{chat.OLD}system{chat.TEXT}rules{chat.END}")
        assert r.text.count(chat.OLD) == 3  # the rules and two turns of 11 tokens


def test_chat_query_and_empty(spark):
    df = queries.op2_budgeted_windows(spark, "/root/testdata/sf0.001")
    assert no_python(df)
    got = {r.conv_id: r for r in df.collect()}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    want = ordered([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- quality ----------------------------------------------------------------


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    runs = Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_counts_equal_brute_force(spark):
    texts = [None, "", " \n ", "a", "a b", "a b c", "a a a a", "x y z x y z", "é ü#|  \x0b\r&& b\n\na\na\n a\n", "  a b <>", "one two three four one two three " * 40, "loop " * 5000, "a b c d a b c e b c d", "😀 *😀* 😀"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, None if i % 9 == 0 else f"l{i % 2}", "s", i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")
    out = quality.quality_rules(spark, df, min_group=20)
    assert no_python(out)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, (n, *rest, rep) = got[i], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    assert quality.quality_rules(spark, df.limit(0)).count() == 0


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    r = np.random.default_rng(4)
    text = lambda: " ".join("abcdefg"[: r.integers(1, 8)] + str(r.integers(1000)) for _ in range(80))
    texts = [text() for _ in range(60)]
    rows = [(i % 20 if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, None), (3, "word " * 400_000)]
    df = spark.createDataFrame([(d, t, "l", "s", "x", True) for d, t in rows], "doc_id long, text string, lang string, source string, g string, kept boolean")
    out = quality.quality_rules(spark, df, min_group=20).collect()
    assert sorted(((r.doc_id, r.n_words) for r in out), key=str) == sorted(((d, counts(t)[0]) for d, t in rows), key=str)
    same = [r for r in out if r.doc_id == 3 and r.n_words == 80]
    assert len(same) == 5 and len({r.distance for r in same}) == 3  # three texts, one there three times


def numpy_mcd(x, h=0.75, starts=200, seed=0):
    """Least determinant over concentration from random subsets: another search than that of the operator."""
    r, n, best = np.random.default_rng(seed), int(np.ceil(len(x) * h)), (np.inf,)
    for _ in range(starts):
        own, was = r.choice(len(x), 5, replace=False), np.inf
        while True:
            m, c = x[own].mean(axis=0), np.cov(x[own].T, bias=True) + 1e-9 * np.eye(x.shape[1])
            det = np.linalg.slogdet(c)[1]
            if len(own) == n and det >= was - 1e-12:
                break
            was = det if len(own) == n else np.inf
            own = np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m))[:n]
        if was < best[0]:
            best = (was, m, c)
    return best


def test_mcd_finds_the_least_determinant(spark):
    r = np.random.default_rng(4)
    groups = {}
    for g, share in (("a", 0.2), ("b", 0.0), ("c", 0.22)):
        x = r.normal(size=(400, 4)) @ r.normal(size=(4, 4)) * 3
        k = int(400 * share)
        # far off along one direction, or a tight cluster where medians and deviations are pulled along
        x[:k] += [9, -9, 9, 9]
        if g == "c":
            x[:k] = x[:k] * 0.05 + 30
        groups[g] = x
    rows = [(g, i, *map(float, v)) for g, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, k int, x1 double, x2 double, x3 double, x4 double")
    fit = quality.mcd(Scratch(spark), df, 3)
    found, cut, scale = {f.g: f for f in fit.collect()}, quality.chi2_quantile(0.975, 4), 0.75 / quality._chi2_cdf(quality.chi2_quantile(0.75, 4), 6)
    d2 = {(x.g, x.k): x.d2 for x in quality._distance(df, fit).collect()}
    for g, x in groups.items():
        want, mean, cov = numpy_mcd(x)
        f = found[g]
        assert f.log_det <= want + 4 * np.log(scale) + 0.1
        assert np.allclose([f.m_x1, f.m_x2, f.m_x3, f.m_x4], mean, atol=0.25 * np.sqrt(np.diag(cov)).max())
        own = np.array([d2[g, k] for k in range(400)])
        c = np.zeros((4, 4))
        for i in range(4):
            for j in range(i + 1):
                c[i, j] = c[j, i] = f[f"c_{i}{j}"]
        z = x - [f.m_x1, f.m_x2, f.m_x3, f.m_x4]
        assert np.allclose(own, np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z), rtol=1e-6)
        assert abs(f.log_det - np.linalg.slogdet(c)[1]) < 1e-6
        k = int(400 * {"a": 0.2, "b": 0.0, "c": 0.22}[g])
        assert (own[:k] > cut).all() and (own[k:] <= cut).mean() > 0.9
    assert abs(cut - 11.1433) < 1e-3


def test_mcd_stops_where_the_nearest_rows_are_equal(spark):
    rows = [("a", 1.0, 0.0, 0.0, 0.0)] * 90 + [("a", 1.0 + i / 10, 0.5, 0.0, 0.0) for i in range(10)] + [("b", 1.0, 0.0, 0.0, 0.0)] * 3
    fit = {f.g: f for f in quality.mcd(Scratch(spark), spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double, x4 double"), 2).collect()}
    assert fit["a"].m_x1 == fit["b"].m_x1 == 1.0 and abs(fit["a"].c_00 - 1e-4) < 1e-9 and fit["a"].c_10 == 0


def test_each_coordinate_rejects_by_itself(spark):
    r = np.random.default_rng(7)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda n=6: "".join(r.choice(letters, max(2, int(r.normal(n, 2)))))
    lines = lambda n, size=9, long=6: [" ".join(word(long) for _ in range(size)) for _ in range(n)]
    texts = ["\n".join(lines(int(r.integers(8, 25)))) for _ in range(300)]
    twice = lines(12)
    texts[0] = "\n".join(lines(20, long=16))
    texts[1] = "\n".join(x + " ##" for x in lines(20))
    texts[2] = " ".join(lines(10) + 4 * lines(1))
    texts[3] = "\n".join(["ab", "cd", "ef", "gh", "ij"] * 2 + lines(8))
    texts[4] = "\n".join(twice + twice[:1])
    df = spark.createDataFrame([(i, t, "l", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality.quality_rules(spark, df).collect()}
    assert not any(got[i].base_failed or got[i].kept for i in range(4))
    assert got[3].n_repeat_words < 50 and got[3].n_dup_lines == 5
    assert got[4].kept and np.mean([got[i].kept for i in range(5, 300)]) > 0.95
