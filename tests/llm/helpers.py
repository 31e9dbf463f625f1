"""Small tables with every odd case, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators use inside; tables may have them too.
CLASH = "key string, n long, size string, bucket string, rank int, component string, score string, __row string, __part long"


def odd_documents(seed: int = 7, n: int = 60) -> list[tuple]:
    """(doc_id, text, source): near copies, exact copies, shared passages, null, empty and very long texts, repeated rows, null ids."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    say = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, out = say(60), []
    for i in range(n):
        w = say(r.choice([1, 3, 4, 5, 6, 8, 12, 30, 80, 150]))
        if i % 4 == 1 and out:
            w = WORD.findall(out[r.randrange(len(out))][1] or "x")
            for _ in range(max(0, len(w) // r.choice([40, 60, 100]))):
                w[r.randrange(len(w))] = r.choice(vocab)
        if i % 5 == 2:
            at = r.randrange(len(w) + 1)
            w = w[:at] + passage + w[at:]
        text = "".join(x + r.choice([" ", " ", "\n", "\t ", "  "]) for x in w)
        out.append((i, text.upper() if i % 13 == 0 else text, r.choice(["a", "b", "c", None, "é"])))
    out += [(n, None, "a"), (n + 1, "", None), (n + 2, " \n\t ", "b"), (n + 3, out[3][1], "c"), (n + 4, out[3][1], "c"), (n + 5, "x", "a"), (n + 6, "x", "a")]
    out += [(n + 7, " ".join(say(9) * 3000), "a"), (n + 8, "z" * 50_000, "a"), (n + 9, "q w " * 3000, "b")]
    out += [out[8], out[8], (None, out[8][1], "b"), (None, None, None)]
    return out


def table(spark, rows: list[tuple], schema: str = "doc_id long, text string, source string", clash: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    if clash:
        for part in CLASH.split(", "):
            name, kind = part.split()
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.repartition(3)


def shingle_set(text: str | None, n: int = 5) -> frozenset:
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(nodes, links) -> dict:
    near, found = defaultdict(set), {}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for node in sorted(nodes):
        if node not in found:
            reach, todo = {node}, [node]
            while todo:
                for x in near[todo.pop()] - reach:
                    reach.add(x)
                    todo.append(x)
            found.update(dict.fromkeys(reach, min(reach)))
    return found


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
