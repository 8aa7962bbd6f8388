import random
import re
from collections import Counter

from pyspark.sql import functions as F
from siltworks.llm.secrets import BASE, NEEDS, ORDER, ROLE, SCOPE, WEAK, scan, span_text

PATTERNS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def brute(text):
    text = text or ""
    found = []
    for kind in ORDER:
        group, least = (BASE | WEAK)[kind][1:]
        for m in re.finditer(PATTERNS.get(kind) or (WEAK[kind][0]), text, re.ASCII):
            if len(m[group]) >= least:
                found.append((m.start(), ORDER.index(kind), m.end(), kind))
    base = [x for x in found if x[3] in BASE]
    weak = [x for x in found if x[3] in WEAK and all(b[2] <= x[0] or b[0] >= x[2] for b in base)]
    parts = base + weak
    near = [x for x in weak if any(ROLE[p[3]] in NEEDS[x[3]] and max(p[0] - x[2], x[0] - p[2]) <= SCOPE for p in parts)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(base + near))


def test_documents_against_brute_force(spark, docs, rows, none):
    rng = random.Random(4)
    bits = ["password: hunter22", "token=secret=abcdefghi", "SECRET = 'x.y-z/+=1'", "token: abc", "secret=token: abcdefgh", "AKIA" + "Z9" * 9, "AKIAAKIA" + "B" * 9, "0123456789abcdef01234567", "0" * 23, "user_name: bob.smith", "client_id=77aa", "https://db.example.org/x?y=1", "10.0.0.12", "Zk39xLq8Tt02mmPQ7bN4", "é€𝄞", "\n", "words in between " * 8]
    more = [(5000 + i, " ".join(rng.choice(bits) for _ in range(rng.randrange(14)))) for i in range(300)]
    frame = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = Counter((r.doc_id, r.s) for r in scan(frame).select("doc_id", span_text(F.col("found")).alias("s")).collect())
    assert got == Counter((i, brute(t)) for i, t in rows + more)
    assert sum(n for (_, s), n in got.items() if "endpoint" in s) > 10
    assert scan(none).count() == 0


def test_long_parts(spark):
    """A key whose first digit stands behind 200 characters, and a key after a URL longer than the scope."""
    far, near = "https://" + "h" * 219, "aB" * 10 + "7" * 20
    texts = ["login: bob " + "aB" * 101 + "7" * 20, f"{far} {near}", f"{near}{' ' * SCOPE}{far}", f"{near}{' ' * (SCOPE + 1)}{far}", " " * 199 + near + " " * SCOPE + far]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in scan(frame).select("doc_id", span_text(F.col("found")).alias("s")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert [len(got[i].split(",")) if got[i] else 0 for i in range(5)] == [2, 2, 2, 0, 2]


def test_plan_has_no_user_function(docs):
    plan = scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
