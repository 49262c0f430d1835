"""Every operator against a plain computation, and over nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coppice.llm import chat, components, decontaminate, importance, licenses, main_text, mixing, near_duplicates, quality_rules, repeats, textops, toxicity

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, spans string, n_words string"


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.random() ** 2 * words)}" + rng.choice(["", "", "", ".", ",\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, prose(rng, rng.randint(1, 300)), "en", f"s{i % 3}") for i in range(60)]
    passage = prose(rng, 130)
    out += [(60 + i, prose(rng, 40) + passage + prose(rng, 40), "de", "s0") for i in range(5)]
    base = prose(rng, 200).split(" ")
    for i in range(12):
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(len(copy))] = f"x{rng.random()}"
        out.append((70 + i, " ".join(copy), None, None))
    out += [(90, out[3][1], "fr", "s1"), (90, out[3][1], "fr", "s1"), (91, None, "en", "s1"), (92, "", "en", "s2"), (93, " \n\t ", None, "s2"), (None, out[5][1], "en", "s2"), (None, None, None, None)]
    out += [(94, "a b c", "en", "s0"), (95, "A b C", "en", "s0"), (96, "a" * 3000, "en", "s0"), (97, "é" * 900 + " ", "en", "s0"), (98, ("ab cd\n") * 400, "en", "s1"), (99, prose(rng, 60_000, 3000), "en", "s0")]
    return [(*r, len(r[1]) if r[1] is not None else None, "x", "y", "z", "q") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, 1000) for i in range(900, 1000)] + [(i, i + 1) for i in range(2000, 2060)] + [(None, 3), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- quality rules


def base_counts(text):
    w = words(text)
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, rows, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality_rules.risk_controlled(docs, labels).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = Counter((r[0], *base_counts(r[1])) for r in rows)
    assert Counter((r.doc_id, *(r[f] for f in fields)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)  # too few labels to certify any cutoff
    assert quality_rules.risk_controlled(none, labels).count() == 0


def test_quality_bounds():
    assert abs(quality_rules.binomial_cdf(2, 10, 0.5) - 56 / 1024) < 1e-12
    good, bad = [0] * 40 + [500] * 24, [0] * 10 + [900] * 54
    assert quality_rules.certify(good, bad, 1000, 1000, 0.01, 0.001) == 10  # the most lenient that separates
    assert quality_rules.certify([0] * 64, [9] * 64, 100, 10, 0.01, 0.001) is None  # too few good texts for the bound
    # the guarantee: over many draws the true false rejection seldom passes the risk
    rng, broken = np.random.default_rng(0), 0
    for _ in range(300):
        true = np.linspace(0, 0.2, 64)
        good = [int(rng.binomial(2000, p)) for p in true]
        at = quality_rules.certify(good, list(range(64)), 2000, 64, 0.02, 0.05)
        broken += at is not None and true[at] > 0.02
    assert broken <= 300 * 0.09


def test_quality_rejects(spark):
    rng = random.Random(3)
    data = [(i, " ".join(f"v{rng.randrange(5000)}" + ("***" if i % 4 == 0 else "") for _ in range(80)), "en" if i % 2 else None) for i in range(8000)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(8000)], "doc_id long, quality int")
    got = quality_rules.risk_controlled(spark.createDataFrame(data, "doc_id long, text string, lang string"), labels).collect()
    assert all(r.kept == (r.doc_id % 4 != 0 or r.doc_id % 2 == 1) for r in got)


def test_quality_cutoffs_by_brute_force(spark):
    """kept of every row against cutoffs recomputed from the labelled rows, with exact binomial sums."""
    rng = random.Random(12)
    data, marks = [], []
    for i in range(3000):
        lang, bad = rng.choice(["a", "a", "b", "b", "c", None]), rng.random() < 0.15
        share = rng.random() * (0.9 if bad else 0.1)
        data.append((i, " ".join(w.upper() if rng.random() < share else w + ("!" if bad and rng.random() < share else "") for w in (f"v{chr(97 + rng.randrange(26))}{rng.randrange(3000)}" for _ in range(rng.randint(45, 90)))), lang))
        if lang != "c" or i % 40 == 0:
            marks.append((i, int(bad == (rng.random() < 0.01))))
    docs, labels = spark.createDataFrame(data, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int")
    ruled = quality_rules.with_rules(quality_rules.measure(docs))
    half = F.pmod(F.xxhash64("doc_id", F.lit(quality_rules._SEED)), F.lit(2)) == 0
    got = {r.doc_id: r for r in quality_rules.risk_controlled(docs, labels).withColumn("draws", half).collect()}
    good, risk, error = dict(marks), 0.03, 0.05
    cutoffs = [1 - i / 64 for i in range(64)]
    reject = lambda r, step: any(i is not None and r[rule] >= cutoffs[i] for rule, i in zip(quality_rules.RULES, step))
    paths, tests = {}, {}
    for lang in ("a", "b", "c", None):
        mine = [r for r in got.values() if r.stratum == lang and r.doc_id in good and not r.base_failed]
        first, second = ([r for r in mine if r.draws == x] for x in (True, False))
        fine = [r for r in first if good[r.doc_id]]
        lost = [[sum(r[rule] >= c for r in fine) for c in cutoffs] for rule in quality_rules.RULES]
        strict = lambda rule, most, lost=lost: max((i for i in range(64) if lost[rule][i] <= most), default=-1)
        steps = [[i - m if (i := strict(k, 0)) - m >= 0 else None for k in range(5)] for m in quality_rules.MARGINS]
        steps += [[i if (i := strict(k, x * len(fine))) >= 0 else None for k in range(5)] for x in quality_rules.SHARES]
        paths[lang] = steps if fine else []
        ok = [r for r in second if good[r.doc_id]]
        below = lambda k, n: sum(math.comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1))
        p = [below(sum(reject(r, s) for r in ok), len(ok)) if ok else 1.0 for s in paths[lang]]
        tests[lang] = (p, [sum(reject(r, s) for r in second if not good[r.doc_id]) for s in paths[lang]], [sum(reject(r, s) for r in ok) for s in paths[lang]], len(ok), sum(not good[r.doc_id] for r in second))
    left = {lang: max(t[0], default=1.0) for lang, t in tests.items()}
    share = error / 4
    while left and (done := [x for x, p in left.items() if p <= share]):
        for x in done:
            del left[x]
        share = error / max(1, len(left))
    used = {}
    for lang, (p, bad, lost, n_good, n_bad) in tests.items():
        best, gain = None, 0.0
        for k in range(len(p)):
            if p[k] > share:
                break
            if (now := bad[k] / max(1, n_bad) - lost[k] / n_good) > gain + 1e-12:
                best, gain = k, now
        used[lang] = paths[lang][best] if best is not None else [None] * 5
    assert any(i is not None for i in used["a"]) and any(i is not None for i in used["b"]) and used["c"] == [None] * 5
    for r in got.values():
        assert r.kept == (not r.base_failed and not reject(r, used[r.stratum])), (r, used)


def test_quality_strata_stand_alone(spark, monkeypatch):
    rng = random.Random(6)
    plain = lambda: " ".join(f"v{rng.randrange(5000)}" for _ in range(60))
    rows = [(plain(), "big", 1) for _ in range(3000)] + [(plain().upper(), "big", 0) for _ in range(200)]
    rows += [(plain(), f"some{i}", 1) for i in range(64) for _ in range(3)] + [(plain(), f"few{i}", 1) for i in range(1600)] + [(plain().upper(), f"few{i}", 0) for i in range(300)]
    rows += [(plain().upper(), x, None) for x in ("big", "some7", "few900", "unseen", None)]
    docs = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(rows)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, (_, _, q) in enumerate(rows) if q is not None], "doc_id long, quality int")
    for limit in (100_000, 0):
        monkeypatch.setattr(quality_rules, "BROADCAST", limit, raising=False)
        got = {r.doc_id: r.kept for r in quality_rules.risk_controlled(docs, labels).collect()}
        assert len(got) == len(rows)
        # only the stratum with labels enough for a bound of its own loses texts
        assert all(got[i] == (s != "big" or t == t.lower()) for i, (t, s, _) in enumerate(rows))


# -- decontamination


def normal(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def overlaps_plainly(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = normal(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(str(i) if i is not None else "null")
    out = Counter()
    for r in rows:
        w, hit, found = normal(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[x]
        out[(r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.mark.parametrize("block_bytes", [8_000_000, 300])
def test_decontaminate(spark, docs, rows, none, block_bytes):
    items = [(i, " ".join(normal(r[1])[5 : 5 + 8 * i])) for i, r in enumerate(rows) if r[1]][:30]
    items += [(100, "A, b"), (100, "c"), (101, None), (102, "!"), (103, items[7][1].upper()), (None, items[9][1]), (104, rows[10][1][:60] + " nothing like this"), (105, "zz")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.overlaps(docs, benchmark, block_bytes=block_bytes)
    got = decontaminate.report(found).collect()
    assert Counter(tuple(r)[:6] for r in got) == overlaps_plainly(rows, items)
    for r in got:
        assert (r.longest_match is None) == (not r.contaminated)
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r.contaminated for r in got)
    assert decontaminate.report(decontaminate.overlaps(none, benchmark)).count() == 0
    empty = decontaminate.report(decontaminate.overlaps(docs, benchmark.where("item_id = 102 or item_id = 101"))).where("contaminated")
    assert empty.count() == 0
    assert decontaminate.decontaminate(docs, benchmark.where("false")).count() == docs.count()


def test_longest_match(spark):
    text = " ".join(f"t{i}" for i in range(100))
    item = " ".join([*(f"t{i}" for i in range(20, 45)), "other", *(f"t{i}" for i in range(60, 72))])
    r = decontaminate.report(decontaminate.overlaps(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))).first()
    assert (r.longest_match, r.longest_at, r.longest_item, r.n_hit) == (25, 20, "9", 37)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    ids = rng.integers(1, 4, 400)
    ends = np.repeat([150, 400], [150, 250])
    got = decontaminate.suffix_array(ids, ends, np.arange(400), 64)
    suffix = lambda i: ids[i : min(ends[i], i + 64)].tolist()
    assert [suffix(i) for i in got] == sorted(map(suffix, range(400)))


# -- importance resampling


def test_importance(spark, docs, none):
    rng = random.Random(5)
    data = [(i, prose(rng, 100) if i % 3 else " | ".join(f"@@{rng.randrange(400)}" for _ in range(60))) for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 900, 2)] + [(1, None), (None, 1), (5000, 1)], "doc_id long, quality int")
    got = importance.resample(df, labels).collect()
    assert all(r.selected == (r.doc_id % 3 > 0) for r in got)
    assert {tuple(r) for r in got} == {tuple(r) for r in importance.resample(df.repartition(7), labels).collect()}
    top = importance.resample(df, labels, k=100).where("selected")
    assert top.count() == 100
    kept = importance.keep_selected(df.withColumn("n_grams", F.lit("x")), labels)
    assert kept.columns == ["doc_id", "text", "n_grams"] and kept.count() == 600
    assert importance.resample(docs, labels.where("false")).where("selected").count() == docs.count()
    assert importance.keep_selected(docs, labels).columns == docs.columns
    assert importance.resample(none, labels).count() == 0 and importance.resample(none, labels, k=5).count() == 0


def test_importance_by_brute_force(spark):
    """Weights, keys and selection recomputed plainly from the texts and labels."""
    rng = random.Random(16)
    data = [(i, prose(rng, rng.randint(0, 60)) if i % 4 else " | ".join(f"@@{rng.randrange(60)}" for _ in range(rng.randint(1, 30)))) for i in range(300)] + [(301, None), (302, "")]
    marks = [(i, int(i % 4 > 0)) for i in range(0, 300, 3)]
    df, labels = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    buckets, span = 512, 40
    held = {r.i: r.h or not r.q for r in labels.select(F.col("doc_id").alias("i"), F.col("quality").alias("q"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).alias("h")).collect()}

    def grams(text):
        found = [w.encode() for w in re.findall(r"[0-9a-z\x80-\U0010FFFF]+|[^0-9a-z\x80-\U0010FFFF\s]+", (text or "").translate(LOWER))]
        hashes = [importance.xxhash.xxh64_intdigest(w, importance._SEED) for w in found]
        pairs = [1 if a == b else int(textops.mix(np.array([(x * 3 + y) % 2**64], np.uint64))[0]) for a, b, x, y in zip(found, found[1:], hashes, hashes[1:])]
        return [h % buckets for h in hashes + pairs]

    raw, target = np.zeros(buckets), np.zeros(buckets)
    for i, t in data:
        np.add.at(raw, grams(t), 1)
        if i in held and not held[i]:
            np.add.at(target, grams(t), 1)
    ratio = np.log((target + 10) / (raw * target.sum() / raw.sum() + 10))
    got = importance.resample(df, labels, k=50, buckets=buckets, span=span)
    noise = {r.doc_id: r.g for r in df.select("doc_id", importance.gumbel(F.xxhash64("doc_id", "text", F.lit(1))).alias("g")).collect()}
    keys = {}
    for i, t in data:
        g = grams(t)
        keys[i] = (len(g), sum(ratio[x] for x in g) * min(1, span / max(1, len(g))))
    top = sorted(keys, key=lambda i: -(keys[i][1] + noise[i]))[:50]
    for r in got.collect():
        assert r.n_grams == keys[r.doc_id][0] and abs(r.log_weight - keys[r.doc_id][1]) < 1e-6 and abs(r.gumbel_key - keys[r.doc_id][1] - noise[r.doc_id]) < 1e-6
        assert r.selected == (r.doc_id in top)


def test_gumbel_top_k_samples_by_weight(spark):
    n = 20000
    df = spark.range(n).withColumn("w", F.when(F.col("id") % 2 == 0, F.log(F.lit(3.0))).otherwise(0.0))
    keyed = df.withColumn("key", F.col("w") + importance.gumbel(F.xxhash64("id")))
    border = importance.kth_largest(keyed, "key", 200)
    assert keyed.where(F.col("key") >= border).count() == 200
    first = keyed.where(F.col("key") >= border).where("id % 2 = 0").count() / 200
    assert 0.62 < first < 0.88  # three to one
    assert importance.kth_largest(keyed, "key", n) == keyed.agg(F.min("key")).first()[0]


# -- chat


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["\\", "#", "##", "###", "### assistant: ", "</turn>", "</turn>\n", "<", "/turn>", ":", ": ", "\n", "a", "é😀", "\\.", "\\#", "\\/"]
    talk = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    turns = [[(rng.choice(["user", "assistant", talk()]), talk()) for _ in range(rng.randrange(5))] for _ in range(400)]
    data = [(i, j, r, t) for i, ts in enumerate(turns) for j, (r, t) in enumerate(ts)]
    done = chat.format_records(chat.records(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")))
    for r in done.withColumns({"back": chat.unformat(F.col("formatted")), "lost": chat.masked_texts(F.col("formatted"), F.col("loss_mask"))}).collect():
        assert [tuple(t) for t in r.back] == turns[r.conv_id]
        assert r.lost == [t for who, t in turns[r.conv_id] if who == "assistant"]
        assert r.formatted.count("</turn>") == len(turns[r.conv_id]) == len(re.findall("###", r.formatted))


def test_chat_edges(spark):
    data = [(1, 0, None, None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, 0, "user", "q"), (2, None, "assistant", "late"), (2, 5, "user", "early"), (3, 0, "assistant", "ü" * 70000)]
    df = spark.createDataFrame([(*r, 0) for r in data], "conv_id long, turn long, role string, text string, layout int")
    got = {r.conv_id: r for r in chat.digest(chat.format_records(chat.records(df))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("\n\nassistant\nx\nassistant\nx\n") and got[1].loss_sha256 == sha("xx")
    assert got[2].turns_sha256 == sha("user\nearly\nassistant\nlate\n")
    assert got[3].loss_chars == 70000 and got[None].loss_sha256 == sha("")
    assert chat.digest(chat.format_records(chat.records(df.where("false")))).count() == 0


def test_chat_layouts(spark):
    data = [
        ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}],"id":3}', "messages", "user:hi|assistant:yo"),
        ('{"instruction":"a","input":"b","output":"c"}', "instruction", "user:a\n\nb|assistant:c"),
        ('{"instruction":"a","output":null}', "instruction", "user:a|assistant:"),
        ('{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":"y"}],"system":"s"}', "conversations", "system:s|user:x|assistant:y"),
        ('{"rounds":[{"user":"u","assistant":"a"},{"user":"v","assistant":null}]}', "rounds", "user:u|assistant:a|user:v|assistant:"),
        ('{"question":"q","answer":"a","context":"c"}', "question_answer", "user:c\n\nq|assistant:a"),
        ('{"prompt":"p","completion":"c","response":"r"}', "prompt_completion", "user:p|assistant:c"),
        ('{"prompt":"hi","messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', "messages", "user:hi|assistant:yo"),
        ('{"instruction":"a","output":"c","context":"b"}', "instruction", "user:a\n\nb|assistant:c"),
        ('{"messages":[{"role":"user","content":[{"type":"text","text":"see"},{"type":"image","url":"u"},{"type":"text","text":"this"},"too"]},{"role":"model","content":["yes"]}]}', "messages", "user:see\nthis\ntoo|assistant:yes"),
        ('{"messages":[{"role":"user","content":7},{"role":"assistant","content":null}]}', "messages", "user:7|assistant:"),
        ('{"messages":"none","question":"q","answer":"a"}', "question_answer", "user:q|assistant:a"),
        ('{"messages":[]}', None, ""),
        ("[1]", None, ""),
        (None, None, ""),
    ]
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(data)], "i int, j string").withColumn("record", F.try_parse_json("j"))
    for r in chat.format_records(df).withColumn("back", chat.unformat(F.col("formatted"))).collect():
        assert (r.layout, "|".join(f"{t.role}:{t.text}" for t in r.back)) == data[r.i][1:]
    assert tuple(chat.unfitted(df).first()) == (len(data), sum(x[1] is None for x in data))


# -- pages

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1><p>Tagline of site.</p></header><div class="cookie-notice">We use cookies. Accept.</div>
<div id=sidebar><h3>Related</h3><p>Some long related text here, that is a teaser of another story.</p></div><main><header><h1>Title here</h1></header><div class="content"><p>First para &amp;
 more&nbsp;text.<p>Second <b>pa</b>ra with <a href=x>a link</a>.<br>Line.<ul><li>item one<li>item two</ul><form><label>Name</label><input></form></div>
<section class="comments"><p>Great article! I loved it so much.</p></section></main><aside>xx</aside><script>if(a<b){"</p>"}</script><!-- <p>no</p> --><footer>&copy; c</footer></body></html>"""


def test_main_text(spark):
    want = "Title here First para & more text. Second para with a link. Line. item one item two"
    data = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "no markup, 1 < 2 & so on. Fine words here.", 1), (5, "u", "<p>" * 3000 + "deep text, but it is a sentence.", 1), (6, "u", "<nav><a href=x>y</a></nav>", 1), (7, "u", "<article><p>" + "long word. " * 50000, 1), (None, "u", "<div", 1)]
    got = main_text.main_texts(spark.createDataFrame(data, "page_id long, url string, html string, text int")).collect()
    by = {r.page_id: r.text for r in got}
    assert by[1] == want and sum(r.page_id == 1 for r in got) == 2
    assert by[2] == by[3] == by[6] == "" and by[4].startswith("no markup, 1 < 2 & so") and by[5].startswith("deep text") and len(by[7]) == 550000 - 1
    assert all(r.n_chars == len(r.text) for r in got)
    assert main_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_after_open_elements():
    article = "<article><h1>Heading</h1><p>" + "A long sentence with many plain words, that tells the reader something. " * 8 + "</p></article>"
    plain = main_text.extract(f"<html><body>{article}</body></html>")
    assert plain.startswith("Heading A long")
    for opened in ("<form><datalist><option value=a><option value=b></datalist></form>", "<form><select><option>One<option>Two</select></form>", "<div><button>Menu</div>", "<div><video src=x></div>", "<div><object data=x></div>", "<div><svg><path d=z></div>", "<svg><path d=z>", "<ul><li><audio src=x><li>", "<script>if (a</b) {}</script >", "<style>b</style\n>"):
        assert main_text.extract(f"<html><body>{opened.replace('<li>', '<li hidden>')}{'</ul>' if '<ul>' in opened else ''}{article}</body></html>") == plain, opened
    inside = article.replace("tells", "<button><div>Press</div></button><svg><text>Icon</text></svg>tells", 1)
    assert main_text.extract(inside) == plain
    assert "holds x+y=1 for" in main_text.extract(article.replace("tells", "holds <math><mi>x</mi><mo>+</mo><mi>y</mi><mo>=</mo><mn>1</mn></math> for", 1))
    assert [b.text for b in main_text.blocks("<ul><li>One<audio src=x>no sound<li>Two</ul><p>Three<canvas>drawn<p>Four")] == ["One", "Two", "Three", "Four"]


def test_tags_in_linear_time():
    """Tags as a regular expression finds them, over random markup; and pages that make it try again and again."""
    tag = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)(?:(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>", re.S)
    rng = random.Random(13)
    bits = ["<p>", "</p>", "<a href='>'>", '"', "'", ">", "<", '<a "', "<!-- x -->", "<!", "<![CDATA[y]]>", " word ", "<b title=", "</B c>", "<!--", "/"]
    for _ in range(4000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        tags, at, got = main_text.Tags(page), 0, []
        while found := tags.after(at):
            got.append((found[0], found[1], found[2]))
            at = found[1]
        assert got == [(m.start(), m.end(), (m[1] or "").lower()) for m in tag.finditer(page)], page
    for piece in ('<a "', '<a ">" ', "<a ", "</script ", "<!", "<a '>", "<div>x", "<b>"):
        main_text.blocks("<script>" + piece * 60_000 + "</script>" + piece * 60_000)


def blocks_kept(page):
    """The main text with the least cost over all labellings, for a page of few blocks."""
    found = main_text.blocks(page)
    gain, links = [main_text.score(b) for b in found], main_text.edges(found, 0.8, 0.4)
    cost = lambda side: sum(g for g, s in zip(gain, side) if g > 0 and not s) - sum(g for g, s in zip(gain, side) if g < 0 and s) + sum(w for a, b, w in links if side[a] != side[b])
    best = min((tuple(bool(m >> i & 1) for i in range(len(found))) for m in range(1 << len(found))), key=cost)
    return " ".join(b.text for b, s in zip(found, best) if s)


def test_main_text_by_brute_force(spark):
    """Whole results against all labellings, over random pages."""
    rng = random.Random(14)
    piece = lambda: rng.choice(["<p>%s</p>", "<div class=%s>%%s</div>" % rng.choice(["nav", "content", "promo", "x"]), "<li>%s", "<nav><a href=x>%s</a></nav>", "<h2>%s</h2>", "<footer>%s</footer>", "<article><p>%s</article>"]) % " ".join(rng.choice(["word", "and", "this,", "end.", "&amp;"]) for _ in range(rng.randint(1, 25)))
    pages = [(i, f"u{i}", "".join(piece() for _ in range(rng.randint(0, 9)))) for i in range(150)]
    got = {r.page_id: r.text for r in main_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: blocks_kept(page) for i, _, page in pages}


def test_minimum_cut_is_minimal():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        links = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(side):
            return sum(g for g, s in zip(gain, side) if g > 0 and not s) - sum(g for g, s in zip(gain, side) if g < 0 and s) + sum(w for a, b, w in links if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(main_text.minimum_cut(gain, links)) - best) < 1e-6


# -- toxicity


def test_toxicity(spark, docs, none):
    rng = random.Random(8)

    def text(toxic):
        w = prose(rng, rng.randint(8, 80)).split(" ")
        for _ in range(2 if toxic else 0):
            w[rng.randrange(len(w))] = "grumb" + "".join(rng.choice("abcdef") for _ in range(4))
        return " ".join(w)

    data = [(i, text(i % 5 == 0)) for i in range(1500)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1500)] + [(None, 1), (2, None)], "doc_id long, toxic int")
    usable = lambda i: toxicity.fold_of(i) != 0
    got = toxicity.toxicity(df, labels, usable).withColumn("held", toxicity.fold_of(F.col("doc_id")) == 0).where("held").collect()
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in got)
    assert right >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    # labels that may not be used change nothing
    other = labels.withColumn("toxic", F.when(toxicity.fold_of(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {tuple(r) for r in toxicity.toxicity(df, labels, usable).collect()} == {tuple(r) for r in toxicity.toxicity(df.repartition(5), other, usable).collect()}
    assert toxicity.toxicity(docs, labels, usable).count() == docs.count()
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(none, labels).count() == 0


def test_toxicity_sample_outlives_long_texts(spark):
    """One very long labelled text neither ends the sample nor crowds a class out."""
    df = spark.createDataFrame([(i, ("bad " if i % 2 else "fine ") * (30 if i else 100_000)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    kept = toxicity.sample(df, labels, None, 100, 60_000, 5, "doc_id", "text", "toxic").groupBy("toxic").count().collect()
    assert {r.toxic: r["count"] for r in kept} == {0: 19, 1: 20}


def test_kneser_ney_sums_to_one():
    some = [b"abc", b"abd", b"b", b"aab"]
    tables = toxicity.fit(some, np.array([[3.0, 1, 2, 0], [1, 1, 0, 4]]))
    # the chances of all next bytes after a history, known or not
    for order in range(1, toxicity.ORDER + 1):
        grams, seen, history, total, distinct = tables[order]
        for h, n, t in zip(history, total.T, distinct.T):
            inside = (grams >> np.uint64(8)) == h
            for c in range(len(n)):
                left = np.maximum(seen[c][inside] - 0.75, 0).sum()
                assert abs(left + 0.75 * t[c] - n[c]) < 1e-4


# -- licences


def test_licenses(spark, docs, none):
    data = [
        (1, "x\nReleased under the MIT License.\ny"),
        (2, "This work is licensed under the GNU General Public License, version 2."),
        (3, 'a\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files (the "Software"),\n to deal in the Software without restriction\n \nz'),
        (4, "Released under a licence"),
        (5, None),
        (6, ""),
        (7, "word " * 40000 + "\nreleased UNDER the mit license"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(1, 8)] == ["MIT", "GPL-2.0", "MIT", "", "", "", "MIT"]
    assert got[1].best_line == 2 and got[1].best_dice == 1.0 and got[3].best_line == 0 and got[5].n_lines == 1 and got[7].best_line == 2
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(none).count() == 0


def test_license_windows(spark):
    full = {p.stem: p.read_text() for p in licenses._FULL.glob("*.txt")}
    short = full["MIT"].split("\n\n")[0]
    header = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    cases = [
        ("Some words. This project is licensed under the MIT License, see the file for more. " * 1, "MIT", 1),
        ("one\ntwo\n" + " ".join(short.split()) + "\nthree", "MIT", 3),
        ("x = 1  # SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0", 1),
        (" ".join(f"b{i}" for i in range(60)) + "\n" + header.format(2).replace("the terms", "\nthe terms") + " ".join(f" e{i}" for i in range(60)), "GPL-2.0", 2),
        ("Released under the MIT License.\nfoo bar\nand this part is licensed under the GPLv3 only", "GPL-3.0,MIT", None),
        ("a license to kill, permission denied, the work is not licensed under anything", "", None),
    ]
    cases += [("intro " * 30 + "\n" + full[x] + "\nthe end " * 30, x, None) for x in ("Apache-2.0", "BSD-3-Clause", "ISC", "MPL-2.0")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")).collect()}
    for i, (_, names, line) in enumerate(cases):
        assert set(names.split(",")) <= set(got[i].licenses.split(",")), (i, got[i])
        assert line is None or (got[i].licenses, got[i].best_line) == (names, line), got[i]
    assert got[5].n_segments == 0 and got[4].n_segments == 2


def test_license_guards(spark):
    """No template can be matched by a text without a guard, and a scan that looks at all texts gives the same rows."""
    known, least = licenses._for_windows(), licenses.MIN_DICE / (2 - licenses.MIN_DICE) - 1e-9
    words = set(licenses.guards(known, least))
    for name, grams, _ in known:
        assert sum(not words & set(g.split(" ")) for g in grams) < len(grams) * least, name
    rng = random.Random(15)
    parts = [t.lower().split() for _, t in licenses.TEMPLATES + licenses.MORE] + [["plain", "words", "here"], ["CC", "BY", "4.0", "\n"]]
    cut = lambda p: p[: rng.randint(1, len(p))]
    data = [(i, " ".join(w for _ in range(rng.randint(1, 4)) for w in cut(rng.choice(parts)))) for i in range(400)] + [(500, None), (501, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got, every = (sorted(map(tuple, licenses.scan(df, guarded=x).collect()), key=str) for x in (True, False))
    assert got == every and sum(r[2] > 0 for r in got) > 50


# -- mixing


def test_permutations(spark):
    for n in (1, 2, 7, 100, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), 5, F.lit(3))).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(1000))


def goals(sizes):
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped, left = {}, dict(sizes)
    while True:
        rest, over = sum(sizes.values()) - sum(capped.values()), sum(weights[s] for s in left)
        new = {s: 3.0 * sizes[s] for s in left if rest * weights[s] / over > 3 * sizes[s]}
        if not new:
            return capped | {s: rest * weights[s] / over for s in left}
        capped |= new
        left = {s: n for s, n in left.items() if s not in new}


def test_mixing(spark, docs, rows, none):
    more = spark.createDataFrame([(200 + i, "w " * (3 + i), "en", "tiny", 0, "", "", "", "") for i in range(3)], SCHEMA)
    every = docs.unionByName(more)
    got = mixing.taken(every, block=16).collect()
    assert len(got) == every.count()
    by_source = {(r.doc_id, r.text): r.source for r in every.collect()}
    sizes = Counter()
    for r in every.collect():
        sizes[r.source] += len(words(r.text))
    want = goals(sizes)
    by_size = {}
    for r in got:
        assert r.taken <= 3 * r["size"]
        by_size.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert sorted(by_size) == sorted(set(sizes.values()))
    for s, n in sizes.items():
        target, took = by_size[n]
        assert abs(target - want[s]) < 1e-6 * max(1, target) and abs(took - target) <= 40
    assert by_source
    again = mixing.taken(every.repartition(5), block=16).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    plan, _ = mixing.mix(every, block=16, slots_per_shard=50)
    slots = plan.select("shard", "slot").distinct().count()
    assert slots == plan.select("shard", "slot", "sid", "block").distinct().count()
    assert mixing.taken(none).count() == 0
    assert mixing.taken(docs.where("size(split(coalesce(trim(text), ''), ' ')) < 2").where("text is null or text = ''")).agg(F.sum("taken")).first()[0] == 0


# -- repeats


def covered(texts, n):
    """Of each sequence, marks of the elements inside a run of n that stands elsewhere, too."""
    seen = Counter()
    for x in texts:
        seen.update(x[p : p + n] for p in range(len(x) - n + 1))
    out = []
    for x in texts:
        gone = bytearray(len(x))
        for p in range(len(x) - n + 1):
            if seen[x[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        out.append(gone)
    return out


def repeats_plainly(rows, n=400, passage=50):
    texts = [(r[1] or "").encode() for r in rows]
    out = Counter()
    for r, b, gone, told in zip(rows, texts, covered(texts, n), covered([tuple(words(r[1])) for r in rows], passage)):
        kept = bytes(x for x, c in zip(b, gone) if not c)
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(b)))
        out[(r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), sum(told), sum(told) > 0)] += 1
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 20, 2])
def test_repeats(spark, docs, rows, none, hot):
    short = [r for r in rows if r[0] != 99]
    got = repeats.report(docs.where("doc_id is null or doc_id != 99"), hot=hot).collect()
    assert Counter(map(tuple, got)) == repeats_plainly(short)
    assert repeats.report(none).count() == 0


@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_few_edges_need_no_rounds(spark, monkeypatch, kind):
    rng = random.Random(5)
    name = {"long": int, "string": lambda x: f"n\u00e9{x}", "binary": lambda x: bytes([x % 251, x // 251])}[kind]
    edges = spark.createDataFrame([(name(rng.randrange(400)), name(rng.randrange(400))) for _ in range(180)] + [(None, name(1)), (name(2), name(2))], f"a {kind}, b {kind}")
    marks, plain = [], components._mark
    monkeypatch.setattr(components, "_mark", lambda e: marks.append(1) or plain(e))
    few = sorted((r.node, r.root) for r in components.components(edges).collect())
    assert len(marks) == 1  # no round
    monkeypatch.setattr(components, "SMALL", 0)
    assert few == sorted((r.node, r.root) for r in components.components(edges).collect()) and len(marks) > 2


def test_frequent_anchors_are_found_once(spark, monkeypatch):
    line = " ".join(f"word{i}" for i in range(120))
    docs = spark.createDataFrame([(i, f"{i} {line} {i}") for i in range(30)], "doc_id long, text string")
    seen, plain = spark.sparkContext.accumulator(0), repeats.find_anchors

    def counting(keyed, rules):
        found = plain(keyed, rules)

        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return found.mapInArrow(run, found.schema)

    n = plain(docs.select(F.col("doc_id").alias("kid"), F.xxhash64("text").alias("kh"), "text"), [repeats.STRINGS]).count()
    monkeypatch.setattr(repeats, "find_anchors", counting)
    spans, name = repeats.repeated_spans(docs, hot=5)
    assert spans.where(F.size(name) > 0).count() == 30
    assert 0 < seen.value <= 3 * n  # to tell the frequent ones, for these, and for the others


def test_repeats_random(spark):
    rng = random.Random(9)
    parts = ["".join(rng.choice("ab é") for _ in range(rng.choice([30, 150, 420]))) for _ in range(14)]
    data = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) + str(i)) for i in range(40)]
    for hot in (repeats.HOT, 1):
        got = repeats.report(spark.createDataFrame(data, "doc_id long, text string"), hot=hot).collect()
        assert Counter(map(tuple, got)) == repeats_plainly(data)


def test_repeated_passages(spark):
    """Passages of 51 words or more are found between any neighbours and white space, also where they are under 400 bytes."""
    rng = random.Random(10)
    passages = [[f"{rng.choice('abcd')}{rng.randrange(900)}" for _ in range(n)] for n in (48, 49, 50, 51, 55, 70)]
    data = []
    for i in range(60):
        text = [f"o{i}x{k}" for k in range(rng.randrange(80))]
        for p in rng.sample(passages, rng.randrange(3)):
            text += p + [f"m{i}x{k}" for k in range(rng.randrange(3))]
        data.append((i, "".join(w + rng.choice([" ", "\n", " \t"]) for w in text)))
    data += [(100, None), (101, ""), (102, data[5][1]), (102, data[5][1]), (None, data[6][1])] + [(103, " ".join(["the"] * 200))] * 3 + [(104, " ".join(["of", "a"] * 90))]
    for hot in (repeats.HOT, 1):
        got = repeats.report(spark.createDataFrame(data, "doc_id long, text string").repartition(3), hot=hot).collect()
        assert Counter(map(tuple, got)) == repeats_plainly(data)


def test_sort_out_in_small_batches(spark):
    """The scan's state holds over the borders of batches: groups of one context, of several, of single rows."""
    rng = random.Random(3)
    data = [(i, 0, i, rng.randrange(40), rng.choice([1, 1, 1, rng.randrange(6)])) for i in range(600)] + [(i, 0, i, 99, 5) for i in range(600, 700)]
    by, contexts = Counter(r[3:] for r in data), defaultdict(set)
    for r in data:
        contexts[r[3]].add(r[4:])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = repeats.sort_out(spark.createDataFrame(data, "kid long, kh long, pos int, a long, c long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    of = {r[0]: r for r in data}
    assert sorted(r.kid for r in got if r.whole) == sorted(r[0] for r in data if by[r[3:]] > 1)
    detail = [of[r.kid] for r in got if r.detail]
    assert Counter((r[3], r[4:]) for r in detail) == Counter((a, c) for a, some in contexts.items() if len(some) > 1 for c in some)


def test_frequent_anchors_under_one_id(spark):
    """An anchor in many copies is seen as frequent, whatever the ids are."""
    text = "".join(f"{i * i:x} " for i in range(120))
    same = spark.createDataFrame([(text,)] * 3000, "text string").repartition(4).select(F.lit(1).cast("long").alias("kid"), F.lit(2).cast("long").alias("kh"), "text")
    got = {r.a for r in repeats.frequent_anchors(same, (repeats.STRINGS,), 1600).collect()}
    assert got == {r.a for r in repeats.find_anchors(same, (repeats.STRINGS,)).distinct().collect()} and got


def test_remove_repeats(spark, docs, rows, none):
    got = repeats.remove_repeats(docs)
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType and got.count() == docs.count()
    assert got.where("text is not null and n_chars != length(text)").count() == 0
    assert got.where("text is null").count() == docs.where("text is null").count()
    assert repeats.remove_repeats(none).count() == 0
    clash = repeats.remove_repeats(docs.withColumns({"row_id": F.lit(1), "ROW_HASH": F.lit("h"), "kid": F.lit(3), "spans_": F.lit(4)}))
    assert {tuple(r) for r in clash.select("row_id", "ROW_HASH", "kid", "spans", "spans_").distinct().collect()} == {(1, "h", 3, rows[0][7], 4)}


def test_remove_repeated_passages(spark):
    """A passage of 51 short words goes from every text, its neighbours stay; a clean text isn't touched."""
    passage = " ".join(f"p{k}" for k in range(51))
    data = [(i, f"before{i} more{i} {passage} after{i}") for i in range(3)] + [(9, "some words of its own")]
    got = dict(repeats.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == {0: "before0 more0  after0", 1: "before1 more1  after1", 2: "before2 more2  after2", 9: "some words of its own"}


def test_interval_tree():
    prefix = np.array([3, 5, 5, 0, 2])
    assert set(repeats.intervals(prefix, 1)) == {(1, 3, 5), (0, 3, 3), (4, 5, 2)}


def groups_plainly(data, rule, split):
    """Every string of `length` symbols or more that stands in two places, with its places; and those that are maximal and seen whole from an anchor of their own."""
    texts = [split(t) for _, t in data]
    places, maximal = defaultdict(list), set()
    for k, x in enumerate(texts):
        for i in range(len(x) - rule.length + 1):
            for n in range(rule.length, min(len(x) - i, 2 * rule.length) + 1):
                places[x[i : i + n]].append((k, i))
    places = {s: at for s, at in places.items() if len(at) > 1}
    for s, at in places.items():
        ends = [{texts[k][i + o] if 0 <= i + o < len(texts[k]) else None for k, i in at} for o in (-1, len(s))]
        if all(None in e or len(e) > 1 for e in ends):
            symbols = repeats.word_symbols(*textops.raw(pa.array([" ".join(s)])))[0] if rule.words else np.frombuffer(s, np.uint8)
            own = repeats.anchors_of_windows(symbols, rule)[0]
            if ((own >= len(s) - rule.length) & (own <= rule.length - rule.gram)).any():
                maximal.add(s)
    return texts, places, maximal


@pytest.mark.parametrize("rule", [repeats.Rule(12, 4), repeats.Rule(6, 2, words=True)])
def test_repeat_groups(spark, none, rule):
    """Every group is one string with all its places; every maximal repeat that fits the contexts is a group; every repeated window lies in one."""
    rng = random.Random(12)
    parts = ["".join(rng.choice("abc ") for _ in range(rng.choice([5, 14, 30]))) for _ in range(12)]
    data = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))) for i in range(50)]
    data += [(60, data[3][1]), (60, data[3][1]), (61, None), (62, ""), (None, data[4][1]), (63, "ab" * 40), (64, "a b " * 30)]
    split = (lambda t: tuple(words(t))) if rule.words else (lambda t: (t or "").encode())
    texts, places, maximal = groups_plainly(data, rule, split)
    assert len(maximal) > 20
    frame, at_id = spark.createDataFrame(data, "doc_id long, text string").repartition(3), defaultdict(list)
    for k, (i, _) in enumerate(data):
        at_id[i].append(k)
    for hot in (repeats.HOT, 3):
        got, covered_by = defaultdict(list), defaultdict(set)
        for r in repeats.repeat_groups(frame, rule, hot).collect():
            got[r.repeat_id].append((r.doc_id, r.low, r.high))
        strings = set()
        for at in got.values():
            content = {texts[at_id[i][0]][low:high] for i, low, high in at}
            assert len(content) == 1
            strings.add(s := content.pop())
            assert Counter((i, low) for i, low, _ in at) == Counter((data[k][0], i) for k, x in enumerate(texts) for i in range(len(x) - len(s) + 1) if x[i : i + len(s)] == s)
            for i, low, high in at:
                covered_by[i] |= {(low + o) for o in range(high - low - rule.length + 1)}
        assert len(strings) == len(got)
        assert hot == 3 or maximal <= strings
        for s, at in places.items():
            if len(s) == rule.length:
                assert all(i in covered_by[data[k][0]] for k, i in at)
    assert repeats.repeat_groups(none, rule).count() == 0


# -- near duplicates


def near_plainly(rows, percent):
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = Counter()
    for members in groups.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        for i in members:
            out[(rows[i][0], len(sets[i]), least, rows[i][0] == least)] += 1
    return out


@pytest.mark.parametrize("size", [near_duplicates.BLOCK_CLASSES, 3])
def test_near_duplicates(spark, docs, rows, none, size, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_CLASSES", size)
    got = near_duplicates.near_duplicates(docs).collect()
    assert Counter(map(tuple, got)) == near_plainly(rows, 85)
    assert near_duplicates.near_duplicates(none).count() == 0


def test_groups_of_many_blocks(spark, monkeypatch):
    """Families of variants with similarities on both sides of the border; the second round has large and small components to compare."""
    monkeypatch.setattr(near_duplicates, "BLOCK_CLASSES", 4)
    reached = []
    still_apart = near_duplicates.still_apart
    monkeypatch.setattr(near_duplicates, "still_apart", lambda *x: reached.append(still_apart(*x)) or reached[-1])
    rng = random.Random(8)
    family = []
    for f in range(3):
        base = [f"v{f}x{rng.randint(0, 500)}" for _ in range(160)]
        for _ in range(40):
            variant = list(base)
            for _ in range(rng.choice([1, 1, 2, 3, 5])):
                variant[rng.randrange(160)] = f"n{rng.randint(0, 10**6)}"
            family.append(" ".join(variant))
    some = [(i, t) for i, t in enumerate(family)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(some, "doc_id long, text string").repartition(5)).collect()
    assert Counter(map(tuple, got)) == near_plainly(some, 85)
    second = reached[0].select("cid", "places").collect()
    assert second and any(p["i"] != p["j"] for r in second for p in r["places"])


def test_one_of_each(spark, docs, rows, none):
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = near_plainly(rows, 80)
    bare = sum(not words(r[1]) for r in rows)
    components_left = len({k[2] for k in groups if k[1]})
    assert kept.count() == bare + components_left
    assert near_duplicates.one_of_each(none).count() == 0


def test_superminhash_estimates():
    rng = np.random.default_rng(3)
    for n in (5, 60, 900):
        both, one, two = (rng.integers(0, 1 << 62, k, dtype=np.uint64) for k in (3 * n, n, n))
        hashes, rows = np.concatenate([both, one, both, two]), np.repeat([0, 1], 4 * n)
        s = near_duplicates.superminhash(hashes, rows, 2, 250)
        assert np.isfinite(s).all() and abs((s[0] == s[1]).mean() - 0.6) < 0.13
        alone = near_duplicates.superminhash(np.concatenate([both, two]), np.zeros(4 * n, np.int64), 1, 250)
        assert (alone[0] == s[1]).all()


# -- tokens and the pipeline


def test_slices_keep_whole_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c"])], names=["t"])
    got = [x.column(0).to_pylist() for x in textops.slices(iter([batch]), "t", 20)]
    assert [y for x in got for y in x] == batch.column(0).to_pylist() and len(got) > 1


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    fine = [prose(rng, rng.randint(60, 200), 3000) for _ in range(300)]
    junk = [" | ".join(f"@@{rng.randrange(400)}" for _ in range(60)) for _ in range(80)]
    passage, item = prose(rng, 120, 3000), prose(rng, 30, 3000)
    texts = fine + junk + [fine[0], fine[1] + " more"] + [prose(rng, 80, 3000) + "\n" + passage + "\n" + prose(rng, 80, 3000) for _ in range(4)] + [prose(rng, 80, 3000) + " " + item for _ in range(3)]
    data = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 300 <= i < 380), 0) for i in range(0, 380)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = textops.settled(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r.doc_id for r in docs.collect()})
    every = set(range(len(texts)))
    assert left[0] == every - set(range(300, 380))
    assert left[1] == left[0] - {380, 381}
    assert left[2] == left[1] and not docs.where(F.contains("text", F.lit(passage))).count()
    assert left[3] == left[2] - {386, 387, 388}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == left[3]


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and repeated rows, columns with clashing names, and empty tables go through the whole chain."""
    rng = random.Random(17)
    texts = [prose(rng, 80, 3000) for _ in range(40)]
    data = [(i, t, "en", f"s{i % 3}", len(t), "a", 1, 2.0) for i, t in enumerate(texts)]
    data += [(5, texts[5], "en", "s0", len(texts[5]), "a", 1, 2.0)] * 2 + [(100, None, None, None, None, None, None, None), (101, "", "en", "s1", 0, "b", 1, 1.0), (None, texts[7] + " x", "de", None, None, "c", 2, 3.0), (None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, row_id int, found_n double"
    for where, rows in (("some", data), ("none", [])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{where}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(20)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{where}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "")] if rows else [], "item_id long, text string").write.parquet(f"{tmp_path}/{where}/benchmark.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{where}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = textops.settled(stage(spark, docs, f"{tmp_path}/{where}"))
            assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        kept = Counter((r.doc_id, r.spans) for r in docs.collect())
        assert kept == (Counter({(i, "a"): 1 for i in range(40) if i != 7} | {(100, None): 1, (101, "b"): 1, (None, None): 1} | ({(7, "a"): 1} if (7, "a") in kept else {(None, "c"): 1})) if rows else Counter())
        got = corpus_pipeline.run(spark, f"{tmp_path}/{where}").collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in kept.elements())
        assert all(r.taken == 0 for r in got if r.doc_id in (100, 101))
