"""The registered web-style search against a brute-force version over whole tables."""

import re

import pyarrow.parquet as pq

from paperlane import queries
from paperlane.functions.porter import stem
from paperlane.operators import lexical

SF = "/root/testdata/sf0.001"


def brute(query, documents, stop):
    """{id: (covers, score)} of the documents that satisfy the query."""
    clauses = lexical.parse_query(query, "english", frozenset(stop))
    wanted = [c for c in clauses if not c.negated]
    out = {}
    for i, terms in documents.items():
        stands = []
        for c in clauses:
            own = {p for phrase, offsets in zip(c.phrases, c.offsets) for p in range(len(terms)) if all(p + o < len(terms) and terms[p + o] == t for t, o in zip(phrase, offsets))}
            stands.append((c, own))
        if not clauses or any(own for c, own in stands if c.negated) or not all(own for c, own in stands if not c.negated):
            continue
        at = sorted(set().union(*(own for c, own in stands if not c.negated))) if wanted else []
        ends = {}
        for end in at:
            last = [max((p for p in own if p <= end), default=None) for c, own in stands if not c.negated]
            if None not in last:
                ends.setdefault(min(last), end)  # the first end of each start
        covers = [(a, b) for a, b in ends.items() if not any((c, d) != (a, b) and a <= c and d <= b for c, d in ends.items())]
        out[i] = len(covers), sum(0.1 / (1 + (b - a) - sum(a < p <= b for p in at)) for a, b in covers)
    return out


def test_web_search_equals_brute_force(spark):
    stop = lexical.stop_words()
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    known = {}
    analysed = lambda t: [None if w in stop else known.setdefault(w, None) or known.__setitem__(w, stem(w)) or known[w] for w in re.findall("[a-z0-9]+", (t or "").lower())]
    documents = {i: analysed(t) for i, t in zip(docs["doc_id"], docs["text"])}
    asked = queries.web_queries(spark, SF).collect()
    got = {}
    for r in queries.web_search_english(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.covers, r.lexical_score))
    hits = 0
    for q in asked:
        want = brute(q["query"], documents, stop)
        best = sorted(want.items(), key=lambda x: (-round(x[1][1], 9), x[0]))[:30]
        mine = sorted(got.get(q["query_id"], []))
        assert [(i, c, round(s, 6)) for i, (c, s) in best] == [(i, c, round(s, 6)) for _, i, c, s in mine], q["query"]
        hits += len(best)
    assert hits > 100
