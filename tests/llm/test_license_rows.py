import random
import re
from collections import Counter

from allelix.llm import license_scan as L


def brute(text, templates, k=5, containment=0.8):
    """Licenses of which some window holds the share of shingles; windows as the operator cuts them."""
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    found = set()
    for name, t in templates.items():
        tw = [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
        n = min(k, len(tw))
        of = {tuple(tw[i : i + n]) for i in range(len(tw) - n + 1)}
        s = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        stride = max(1, len(of) // 2)
        for start in range(0, max(1, len(s)), stride):
            if len(of & set(s[start : start + len(of) + stride - 1])) / len(of) >= containment:
                found.add(name)
    return found


def test_changed_templates_against_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for i in range(120):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(list(L.TEMPLATES.values())).split()
            for _ in range(rng.randint(0, max(0, len(t) // 40))):
                t[rng.randrange(len(t))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = t
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    texts += [None, "", "x", "All rights reserved", "word " * 200_000 + L.TEMPLATES["gpl-warranty"]]
    rows = [(i, t, "en", 1.0) for i, t in enumerate(texts)]
    rows += [rows[0], rows[1], (None, L.TEMPLATES["mit-line"], "x", 0.0), (None, L.TEMPLATES["mit-line"], "x", 0.0), (3, L.TEMPLATES["mit"], "y", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string, containment double")
    got = L.scan(df).collect()
    assert all(r.containment >= 0.8 for r in got)
    want = [(r[0], n) for r in rows for n in brute(r[1], L.TEMPLATES)]
    assert Counter((r.doc_id, r.license) for r in got) == Counter(want) and len(want) > 60
    assert Counter(want)[None, "mit-line"] == 2 and (3, "mit") in want
    assert L.scan(df.limit(0)).collect() == []
