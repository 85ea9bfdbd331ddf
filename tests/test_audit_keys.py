"""Forbidden keys at any depth against a plain walk, without Python in the plan."""

import json
import random
from collections import Counter

from verdict_lake.operators import audit as A


def keys_of(text):
    try:
        todo = [json.loads(text)]
    except ValueError:
        return {"(not JSON)"} if any(f'"{k}":' in text.replace('" :', '":') for k in A.FORBIDDEN_KEYS) else set()
    bad = set()
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            bad |= x.keys() & set(A.FORBIDDEN_KEYS)
        todo += x.values() if isinstance(x, dict) else x if isinstance(x, list) else []
    return bad


def value(draw, depth):
    kind = draw.randrange(6) if depth else draw.randrange(3, 6)
    if kind < 2:
        return {draw.choice((*A.FORBIDDEN_KEYS[:6], *(f"k{n}" for n in range(40)))): value(draw, depth - 1) for _ in range(draw.randrange(4))}
    return [value(draw, depth - 1) for _ in range(draw.randrange(4))] if kind == 2 and depth else draw.choice((1, None, "author", '"body": x', True, 2.5, "é"))


def test_keys_at_any_depth_equal_a_plain_walk(frame):
    draw = random.Random(6)
    texts = [json.dumps(value(draw, 6), separators=draw.choice(((",", ":"), (", ", " : ")))) for _ in range(250)]
    deep = '{"comment": 1}'
    for _ in range(12):
        deep = f'[{{"x": {deep}}}]'
    texts += [deep, "null", "", '{"author": ', "[]", '{"author": 1}', '{"author": 1}']
    lines = frame("value string", *((t,) for t in texts), (None,)).repartition(3)
    want = Counter(k for t in texts for k in keys_of(t))
    found = A.audit_export_keys(lines)
    assert len(want) > 5 and {r.key: r.n for r in found.collect()} == dict(want)
    assert "Python" not in found._jdf.queryExecution().toString()
    assert A.audit_export_keys(lines.limit(0)).count() == 0
