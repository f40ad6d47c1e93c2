"""Small fixtures and plain versions that the operators are held against."""
from __future__ import annotations

import re
from collections import defaultdict

SMALL = "/root/testdata/sf0.001"
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def duck(sql, **frames):
    """Rows of DuckDB SQL over pandas frames, as dicts."""
    import duckdb

    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    rel = con.sql(sql)
    return [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]


def same_rows(spark_rows, duck_rows):
    key = lambda r: sorted((k, str(round(v, 9) if isinstance(v, float) else v)) for k, v in r.items())
    assert sorted(map(key, (r.asDict() for r in spark_rows))) == sorted(map(key, duck_rows))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard_links(texts, threshold=0.8):
    """(i, j) of all pairs of texts whose shingle sets reach the threshold, by comparing all of them."""
    sets, out = [shingles(t) for t in texts], set()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both >= threshold * (len(a) + len(sets[j]) - both) - 1e-9:
                out.add((j, i))
    return out


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def neighbours(pairs):
    out = defaultdict(set)
    for i, j in pairs:
        out[i].add(j)
        out[j].add(i)
    return out
