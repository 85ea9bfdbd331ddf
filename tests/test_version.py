"""Versions of content that is not gathered in one string."""

import hashlib

from verdict_lake.operators import snapshot as X


def test_version_hashes_lines_in_order_without_one_string(frame):
    pairs = [(f"p{k:04}", f"texte é {k}" if k % 5 else None) for k in range(2000)] + [(None, "no id")]
    df = frame("post_id string, explanation string", *pairs[::-1]).repartition(7)
    version = X.dataset_version(df)
    assert "listagg" not in version._jdf.queryExecution().toString().lower()
    line = "".join(p + (e or "") for p, e in pairs if p is not None)
    assert [r[0] for r in version.collect()] == [hashlib.sha256(line.encode()).hexdigest()[:16]]
    empty = X.dataset_version(df.limit(0))
    assert [r[0] for r in empty.collect()] == [hashlib.sha256(b"").hexdigest()[:16]]


def test_tree_version_equals_a_plain_tree(frame):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    pairs = [(f"p{k:04}", f"texte é {k}" if k % 5 else None) for k in range(900)] + [("p0001", "again"), (None, "no id")]
    leaves, nodes = {}, {}
    for p, e in pairs:
        if p is not None:
            leaves.setdefault(sha(p)[:4], []).append(sha(f"{p}\x1f{sha(e or '')}"))
    for leaf, rows in leaves.items():
        nodes.setdefault(leaf[:2], []).append(leaf + sha("".join(sorted(rows))))
    root = sha("".join(sorted(node + sha("".join(sorted(parts))) for node, parts in nodes.items())))
    df = frame("post_id string, explanation string", *pairs)
    for parts in (1, 7):
        assert X.tree_version(df.repartition(parts)).first()[0] == root[:16]
    assert X.tree_version(df.limit(0)).first()[0] == sha("")[:16]
    assert X.tree_version(df.withColumn("explanation", df.post_id)).first()[0] != root[:16]
    assert X.create_snapshot(df, frame("dataset_version string", (root[:16],)), X.tree_version).count() == 0
