"""The corpus pipeline: each stage against its operator's decisions on what the stage before kept."""

import pytest

from tests.conftest import DATA

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    from prosemill.llm import minhash_dedup, packing, quality_rules, secret_scan

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_dedup", "secret_scan", "mixing", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_rules"](spark, docs, DATA).cache()
    assert good.columns == docs.columns and ids(good) == ids(quality_rules.quality_rules(docs, labels).filter("kept"))
    one = stage["minhash_dedup"](spark, good, DATA).cache()
    assert one.columns == docs.columns and ids(one) == ids(minhash_dedup.classes(good).filter("kept"))
    clean = stage["secret_scan"](spark, one, DATA).cache()
    assert clean.columns == docs.columns and ids(clean) == ids(one)
    assert all(r["n_chars"] == len(r["text"]) for r in clean.filter("text is not null").collect())
    assert not any(r["base"] for r in secret_scan.secret_scan(clean).collect())
    mixed = stage["mixing"](spark, clean, DATA).cache()
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(clean))
    packed = stage["packing"](spark, mixed, DATA)
    assert {r[0] for r in packed.select("doc_id").collect()} == set(ids(mixed))
    assert sum(r["length"] for r in packed.collect()) == sum(r["length"] for r in packing.pack(mixed).collect())


def topic(t):
    import re

    if re.search(r"https?://|www\.", t):
        return "web"
    if re.search(r"(?i)licen[sc]e|copyright", t):
        return "legal"
    if re.search(r"\w@\w|\d{3}[-. ]\d{3,4}", t, re.ASCII):
        return "contact"
    return "table" if re.search(r"[{};]\s*\n|\|", t, re.ASCII) else "prose"


def test_run_brute_force(spark):
    """run() against the stages worked out by hand: SQL for rules and spans, all pairs for near copies, plain fitting, whole encodings."""
    import collections
    import hashlib
    import math
    import re
    import zlib

    import duckdb
    import numpy as np

    from prosemill.llm import encoding, minhash_dedup, mixing, packing, quality_rules, secret_scan

    con = duckdb.connect()
    con.execute(f"CREATE VIEW labels AS SELECT * FROM read_parquet('{DATA}/labels.parquet')")
    con.execute(f"CREATE TABLE documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    cur = con.execute(quality_rules.OP5_SQL)
    names = [d[0] for d in cur.description]
    kept = {r[names.index("doc_id")] for r in cur.fetchall() if r[names.index("kept")]}
    docs = {r[0]: r[1:4] for r in con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall() if r[0] in kept}

    bags = {}
    for k, (t, _, _) in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        bags[k] = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    seen = collections.Counter(g for b in bags.values() for g in b)
    n, least = len(docs), max(2.0, minhash_dedup.RARE * len(docs))
    weigh = lambda g: min(1.0, max(minhash_dedup.FLOOR, math.log(n / seen[g]) / math.log(1 / minhash_dedup.RARE))) if seen[g] >= least else 1.0
    whole = {k: sum(c * weigh(g) for g, c in b.items()) for k, b in bags.items()}
    parent = {k: k for k in docs}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bags[a] and bags[b] and 0.75 < (whole[a] + 1e-9) / (whole[b] + 1e-9) < 1.35:
                shared = sum(weigh(g) * min(c, bags[b][g]) for g, c in bags[a].items() if g in bags[b])
                if shared >= 0.8 * (whole[a] + whole[b] - shared) - 1e-9:
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    docs = {k: v for k, v in docs.items() if find(k) == k}

    con.execute("CREATE OR REPLACE TABLE documents AS SELECT * FROM documents WHERE doc_id IN (SELECT unnest(?))", [list(docs)])
    cur = con.execute(secret_scan.OP7_SQL)
    names = [d[0] for d in cur.description]
    for r in cur.fetchall():
        k, spans = r[names.index("doc_id")], [x.split(":") for x in r[names.index("spans")].split(",") if x]
        t, out, at, merged = docs[k][0], "", 0, []
        for kind, a, b in ((x, int(a), int(b)) for x, a, b in spans):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b, kind])
        for a, b, kind in merged:
            out, at = out + t[at:a] + f"[REDACTED:{kind}]", b
        docs[k] = (out + t[at:] if t is not None else None, *docs[k][1:])

    tokens = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, (t, _, _) in docs.items()}
    cell = {k: (s, lang, topic(t or "")) for k, (t, lang, s) in docs.items()}
    cells = collections.Counter()
    for k, c in cell.items():
        cells[c] += tokens[k]
    total, share = sum(cells.values()), {c: v / sum(cells.values()) for c, v in cells.items()}
    targets = []
    for d, power in enumerate(mixing.TEMPER.values()):
        sums = collections.Counter()
        for c, v in cells.items():
            sums[c[d]] += v
        targets.append({x: v**power / sum(y**power for y in sums.values()) for x, v in sums.items()})
    for _ in range(400):
        for d, t in enumerate(targets):
            sums = collections.Counter()
            for c, v in share.items():
                sums[c[d]] += v
            share = {c: v * t[c[d]] / sums[c[d]] if sums[c[d]] else 0.0 for c, v in share.items()}
    times = {}
    for k, (t, _, _) in docs.items():
        p = mixing.KEEP * total * share[cell[k]] / cells[cell[k]] if cells[cell[k]] else 1.0
        unit = int(hashlib.md5(f"{k}/{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
        times[k] = None if abs(unit - p % 1) < 1e-4 else int(p) + (unit < p % 1)

    tokenizer = encoding.load(packing.VOCAB)
    got, room = collections.defaultdict(list), collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, DATA).collect():
        got[r["doc_id"]].append(r)
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, m in times.items():
        pieces = got.pop(k, [])
        assert m is None or sum(p["start"] == 0 for p in pieces) == m, k
        ids = np.array([*tokenizer.encode(docs[k][0] or "", add_special_tokens=False).ids, 2], "<u4")
        assert sum(p["length"] for p in pieces) == len(ids) * sum(p["start"] == 0 for p in pieces)
        assert all(p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces)
    assert not got
    for parts in room.values():
        ends = [sum(x) for x in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert sum(sum(n for _, n in p) < 4096 for p in room.values()) <= 1
