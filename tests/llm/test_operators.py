"""The corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeats, extra columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlane.llm import decontaminate, hmm, line_dedup, packing, pii, quality, sharding, topk, toxicity
from paperlane.llm.queries import tokenizer_path

#: Extra columns bear names that operators use themselves.
SCHEMA = "doc_id long, text string, source string, score double, words string, bucket long, length long"


def docs(spark, texts, hosts=None):
    return spark.createDataFrame([(i, t, hosts[n] if hosts else "h", 0.0, "w", 1, 2) for n, (i, t) in enumerate(texts)], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n "), (4, "a"), (4, "a"), (None, "no id"), (5, "long " * 30_000), (6, "ÄÖ ß 日本 😀 Ab")]


def test_sharding(spark):
    def jump(key, n):
        b, j, key = -1, 0, key % 2**64
        while j < n:
            b = j
            key = (key * sharding.MULTIPLIER + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    rows = ODD + [(i, f"t{i}") for i in range(-20, 300)] + [(7, "same")] * 40
    got = sharding.shard_documents(docs(spark, rows), 16).collect()
    want = sorted((i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(i or 0, 16), jump(i or 0, 17)) for i, t in rows)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for s in range(16):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    assert sharding.shard_documents(docs(spark, []), 16).collect() == []


def test_decontamination(spark):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(12)]
    rows = ODD + [(10 + i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(60)]
    items = [(i, rows[10 + i][1][:40]) for i in range(30)] + [(40, None), (41, "!!"), (42, "v1, V2"), (42, "v1, V2"), (43, rows[-1][1]), (None, "v3 v4 v5")]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))

    def brute(text):
        w, hit, names = low(text), set(), set()
        for i, t in items:
            x = low(t)
            k = min(10, len(x))
            for a in range(len(x) - k + 1) if k else ():
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == x[a : a + k]:
                        hit |= set(range(b, b + k))
                        names |= {str(i)} if i is not None else set()
        return len(w), len(hit), sorted(names)

    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs(spark, rows), benchmark)
    want = sorted((i or 0, *brute(t)) for i, t in rows)
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in found.collect()) == want
    shuffled = decontaminate.contamination(docs(spark, rows), benchmark, broadcast_windows=1)
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in shuffled.collect()) == want
    kept = decontaminate.remove_contaminated(docs(spark, rows), benchmark)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i, t in rows if not brute(t)[1]) and kept.columns == docs(spark, []).columns
    cut = decontaminate.remove_spans(docs(spark, [(1, "Keep. one TWO, three four! last")]), spark.createDataFrame([(1, "two three four")], "item_id long, text string"))
    assert cut.first().text == "Keep. one last"
    assert decontaminate.contamination(docs(spark, []), benchmark).collect() == []
    assert all(not r.n_hit for r in decontaminate.contamination(docs(spark, ODD), spark.createDataFrame([], "item_id long, text string")).collect())


@pytest.mark.parametrize("bound", [100_000, 1])
def test_line_dedup(spark, bound):
    rng = random.Random(4)
    rows = ODD + [(10 + i, "\n".join([f"own {i}"] + ["Common  line"] * (i % 3 == 0) + [rng.choice(["rare a", "rare b"])] * (i % 40 == 0) + ["", "COMMON line "] * (i % 5 == 0))) for i in range(120)]
    hosts = [rng.choice(["x", "y", None]) for _ in rows]
    norm = lambda x: re.sub(r"\s+", " ", x).strip(" ").lower()
    pages = Counter(hosts)
    seen = Counter((h, n) for (i, t), h in zip(rows, hosts) if t is not None for n in {norm(x) for x in t.split("\n")} if n)
    bad = {k for k, n in seen.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    got = line_dedup.drop_boilerplate(docs(spark, rows, hosts), broadcast_lines=bound)
    want = Counter((i, t if t is None else "\n".join(x for x in t.split("\n") if (h, norm(x)) not in bad)) for (i, t), h in zip(rows, hosts))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want and bad
    assert got.columns == docs(spark, []).columns
    assert line_dedup.drop_boilerplate(docs(spark, [])).collect() == []


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = ODD + [(100 + i, "word and more, 12 " * (i % 37)) for i in range(80)] + [(7, "It's <|endoftext|> d'accord\t x y")]
    got = packing.pack_documents(docs(spark, rows), tokenizer_path(), 256).collect()
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i or 0, n, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for n, a in enumerate(range(0, len(ids), 256))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(docs(spark, []), tokenizer_path()).collect() == []


def test_plan_uses_every_piece_once():
    rng = random.Random(0)
    for _ in range(40):
        counts = Counter(rng.randint(1, 64) for _ in range(rng.randint(0, 200)))
        steps = packing.plan(dict(counts), 64)
        used = Counter()
        for lengths, times in steps:
            assert sum(lengths) <= 64 and times > 0
            for x in lengths:
                used[x] += times
        assert used == counts
    assert packing.plan({40: 5, 20: 5, 4: 5}, 64) == [((40, 20, 4), 5)]


def test_base_personal_data():
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 8 <= len(digits(s)) <= 15]
    rng = random.Random(2)
    texts = ["".join(rng.choice("a@.-+1234 ()0b%\n") for _ in range(rng.randint(0, 50))) for _ in range(5000)] + ["4111 1111 1111 1111 a.b@c.de", "1" * 100_000, "a" * 100_000 + "@"]
    for t in texts[:-2]:
        assert pii.base(t) == [[m.span() for m in re.finditer(p, t) if g(m[0])] for p, g in zip(patterns, good)]
    assert pii.base(texts[-1]) == [[], [], [], []] == pii.base(texts[-2])


def test_personal_data(spark):
    rows = ODD + [(20 + i, f"mail x{i}@host.org or 10.0.0.{i}, call +49 30 1234{i:03d}.") for i in range(40)]
    got = {(r.doc_id, r.base_sha256): r for r in pii.digest(pii.find(docs(spark, rows))).collect()}
    for i, t in rows:
        r = got[i, pii.base_digest(t)]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, pii.base(t or "")))
        assert set(pii.joined(pii.base(t or "")).split(",")) <= set(r.spans.split(","))
    assert pii.digest(pii.find(docs(spark, []))).collect() == []


def test_field_beliefs_equal_enumeration():
    """On a document whose links make no loop, message passing is exact."""
    import itertools

    text = "1234567 x 555.1 y a7654321 z 1234567"
    t = pii.Tokens(text, [[], [], [], []])
    field = pii.Field([(repr(s), 0, y, n + 1 + y) for n, s in enumerate(t.shape) for y in range(5)] + [(f"pair{k}", a, b, 1 + a * b + k) for k in (0, 1) for a in range(5) for b in range(5)])
    assert t.links
    weight = {}
    for y in itertools.product(range(5), repeat=len(t.at)):
        weight[y] = math.exp(sum(field.shapes[repr(s)][a] for s, a in zip(t.shape, y)) + sum(field.pairs[k][y[i], y[j]] for i, j, k in t.links))
    total = sum(weight.values())
    pii.SWEEPS, before = 60, pii.SWEEPS
    p = field.beliefs([t])
    pii.SWEEPS = before
    for i in range(len(t.at)):
        for a in range(5):
            assert abs(p[i, a] - sum(w for y, w in weight.items() if y[i] == a) / total) < 1e-6


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=5), 1)]) for i in range(120)] + [(i, [1.0] * 5) for i in range(200, 280)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [float("nan")] * 5), (503, [float("inf")] * 5), (None, [1.0] * 5), (504, [1.0, 2.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v.where("id % 7 = 0"), v, 20, query_block=9, row_block=16).collect())
    whole = {i: [math.floor(64 * float(np.float32(x))) for x in e] for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in (i for i in whole if i % 7 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], e)), i) for i, e in whole.items() if i != q and len(e) == len(whole[q]))[:20]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.top_k(v.where("id < 0"), v).collect() == [] == topk.top_k(v, v.where("id < 0")).collect()


def test_forward_recursion_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    p = hmm.Parameters(norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), norm(rng.random((4, 2)), 0))
    seqs = [np.array(s, np.int32) for s in ([0, 1, 2], [3], [1, 1, 0, 2, 3])]
    total, expected = [], hmm.Expected(4, 2)
    expected.add(p, seqs)
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for s in seqs:
        paths = {}
        for y in itertools.product(range(2), repeat=len(s)):
            paths[y] = p.start[y[0]] * np.prod([p.move[a, b] for a, b in zip(y, y[1:])]) * np.prod([p.emit[x, a] for x, a in zip(s, y)])
        z = sum(paths.values())
        total.append(math.log10(z))
        for y, w in paths.items():
            start[y[0]] += w / z
            for a, b in zip(y, y[1:]):
                move[a, b] += w / z
            for x, a in zip(s, y):
                emit[x, a] += w / z
    assert np.allclose(hmm.log10_likelihood(p, seqs), total)
    assert np.allclose(expected.start, start) and np.allclose(expected.move, move) and np.allclose(expected.emit, emit)


def test_language_model(spark):
    rng = random.Random(0)
    rows = ODD + [(10 + i, " ".join(rng.choices([f"{'en' if i % 2 else 'fr'}{k}" for k in range(30)], k=40))) for i in range(80)]
    train = [(i, t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    model = hmm.train(docs(spark, train), states=3, head=20)
    got = hmm.score(docs(spark, rows), model).collect()
    count = Counter(w for _, t in train for w in hmm.tokens(t))
    n, v = sum(count.values()) + len(train), len(count) + 1
    count["end"] = len(train)
    assert {r.train_tokens for r in got} == {n}
    want = Counter((i, len(w) - 1 + 1, sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 3)) for i, t in rows for w in [[*hmm.tokens(t), "end"]])
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 3)) for r in got) == want
    ours = [r for r in got if r.doc_id and r.doc_id >= 10]
    assert sum(r.score for r in ours) > sum(r.base_score for r in ours)
    assert hmm.score(docs(spark, []), hmm.train(docs(spark, []))).collect() == []


def test_language_model_trains_until_a_pass_over_all_rows_gains_no_more(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{2 * ((i + j // 9) % 6) + rng.randrange(12)}" for j in range(40))) for i in range(400)]
    model = hmm.train(docs(spark, rows), states=4, head=60)
    seqs = [model.alphabet.spell(hmm.tokens(t))[0] for _, t in rows]
    letters = np.concatenate([model.group_tokens, [len(rows)], model.head_counts]) + 1.0
    share, p, reached = letters / letters.sum(), model.parameters, []
    for _ in range(2):
        reached.append(hmm.log10_likelihood(p, seqs).sum() * math.log(10) + hmm.PULL * (share[:, None] * np.log(p.emit)).sum() + 0.5 * (np.log(p.start).sum() + np.log(p.move).sum()))
        e = hmm.Expected(model.alphabet.size, 4)
        e.add(p, seqs)
        p = e.parameters(share)
    assert 0 <= reached[1] - reached[0] < 1e-4 * sum(map(len, seqs))


def test_quality(spark):
    rng = random.Random(0)
    clean = [(i, " ".join(rng.choices([f"word{k}" for k in range(200)], k=60)) + ".") for i in range(160)]
    junk = [(200 + i, rng.choice(["SPAM!! ", "x$$ ###", "rep rep rep "]) * 40) for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i, _ in clean[:120]] + [(i, 0) for i, _ in junk[:30]] + [(None, 1), (999, None)], "doc_id long, quality int")
    d = docs(spark, clean + junk + ODD)
    got = {r.doc_id: r.out for r in quality.score(d, quality.train(d, labels), out="out").collect()}
    assert all(got[i] >= quality.THRESHOLD for i, _ in clean[120:]) and all(got[i] < quality.THRESHOLD for i, _ in junk[30:])
    none = quality.train(d, labels.where("quality = 9"))
    assert {r.out for r in quality.score(d, none, out="out").collect()} == {0.5}


def test_toxicity(spark):
    rng = random.Random(0)
    text = lambda extra: " ".join([*rng.choices([f"w{chr(97 + k)}x" for k in range(26)], k=20), *extra])
    bad, good = [(i, text(["insultish", "muslims"] if i % 2 else ["insultone"])) for i in range(60)], [(100 + i, text(["women"] if i % 9 == 0 else [])) for i in range(140)]
    labels = spark.createDataFrame([(i, 1) for i, _ in bad[:50]] + [(i, 0) for i, _ in good[:100]], "doc_id long, toxic int")
    probe = [(900, text(["muslims"])), (901, text(["women"])), (902, text(["insulttwo"]))]
    d = docs(spark, bad + good + ODD + probe)
    run = lambda c: {r.doc_id: r.out for r in toxicity.score(d, toxicity.train(d, labels, counterfactual=c), out="out").collect()}
    got, without = run(toxicity.COUNTERFACTUAL), run(0.0)
    assert all(got[i] >= toxicity.THRESHOLD for i, _ in bad[50:]) and all(got[i] < toxicity.THRESHOLD for i, _ in good[100:])
    assert got[902] > got[900] and got[900] < 0.5 and got[900] - got[901] < without[900] - without[901]
    assert all(0 <= x <= 1 for x in got.values())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_near_dedup import brute

    rng = random.Random(9)
    body = lambda: "\n".join(" ".join(rng.choices([f"w{k}" for k in range(300)], k=25)) + "." for _ in range(4))
    rows = [(i, body()) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200 + i, "SPAM!! " * 60) for i in range(12)]
    rows += [(300, rows[0][1].replace("\n", "\nThe same line here.\n", 1)), (301, "\nThe same line here.\n".join([body()] * 2)), *[(310 + i, "The same line here.\n" + body()) for i in range(12)]]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    item = " ".join(rows[20][1].split()[30:45])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(not 200 <= i < 300)) for i, _ in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]
    lines = [(i, "\n".join(x for x in t.split("\n") if x != "The same line here.")) for i, t in rows if not 200 <= i < 300]
    keepers = {c for _, c in brute(lines)}
    left = sorted(i for i, t in lines if i in keepers and item.replace(".", "") not in t.replace("\n", " ").replace(".", ""))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in got.collect()}) == left and 20 not in left
