import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pixsieve.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(d, n_chars):
    return digest(*map(field, (d.doc_id, d.source, d.lang, n_chars, d.text)))


def tree(nodes):
    """Levels of a tree, and each leaf's siblings with their sides, by taking two nodes at a time."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return levels[-1][0], [[(i >> j & 1, level[(i >> j) ^ 1]) if (i >> j) ^ 1 < len(level) else None for j, level in enumerate(levels[:-1])] for i in range(len(nodes))]


def brute(docs):
    """Counter of (doc_id, leaf, subroot, root, proof, folded, verified)."""
    by_lang = defaultdict(list)
    for d in docs:
        by_lang[d.lang].append(d)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for g in by_lang.values():
        g.sort(key=lambda d: (d.doc_id is not None, d.doc_id or 0, leaf(d, d.n_chars)))
    trees = [tree([leaf(d, d.n_chars) for d in by_lang[x]]) for x in langs]
    root, above = tree([t[0] for t in trees])
    out = Counter()
    for x, (subroot, paths), up in zip(langs, trees, above, strict=True):
        for d, own in zip(by_lang[x], paths, strict=True):
            path = [*own, *up]
            touched = d.doc_id is not None and d.n_chars is not None and zlib.crc32(str(d.doc_id).encode()) % 7 == 0
            node = leaf(d, d.n_chars + touched if touched else d.n_chars)
            for s in path:
                node = digest(node) if s is None else digest(s[1], node) if s[0] else digest(node, s[1])
            proof = digest(*(s[1] for s in path if s))
            out[d.doc_id, leaf(d, d.n_chars), subroot, root, proof, node, node == root] += 1
    return out


def run(docs):
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.proofs(docs, tampered={"n_chars": (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")}, where=seventh).collect()
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got)


def test_odd_rows(odd_docs, no_docs):
    assert run(odd_docs) == brute(odd_docs.collect())
    assert run(no_docs) == Counter()


def test_blocks_tiers_and_ties(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BITS", 2)  # blocks of four: trees of up to five tiers
    sizes = {"a": 1, "b": 4, "c": 5, "é": 16, "d": 17, "z": 65, None: 300, "": 2}
    rows = [(1000 * k + i // 2, f"t{i}" if i % 5 else None, x, "s", i if i % 3 else 2**63 - 1) for k, (x, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(7, "same", "tie", "s", 4)] * 9
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").repartition(5)
    assert run(docs) == brute(docs.collect())


def test_any_changed_leaf_fails(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "'en' AS lang", "repeat('x', int(id % 9)) AS text")
    got = merkle.proofs(docs, names=("doc_id", "text"), tampered={"text": F.lit("other")}, where=F.col("doc_id") % 10 == 3).collect()
    assert all(r.verified == (r.doc_id % 10 != 3) for r in got) and len({r.root for r in got}) == 1
