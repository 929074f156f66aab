"""The filter audit against every order applied to every document."""

import itertools
import re

from varcohort.llm.filters import audit, interactions

DOC = "doc_id long, text string, lang string, mask int, part string, n int"
LABEL = "doc_id long, quality int, toxic int, part int"


def brute(docs, labels):
    rows = []
    for i, (doc_id, text, lang) in enumerate(docs):
        x = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", x)) > 3 * len(x), "D": bool(re.search("[#$%&*|]", x)),
            "E": doc_id is not None and any(o is not None and o < doc_id and (t or "") == x for o, t, _ in docs),
        }
        own = [(q, t) for d, q, t in labels if d is not None and d == doc_id]
        rows.append((lang or "", fails, any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = [r for r in rows if r[0] == part]
            for step, letter in enumerate(order, 1):
                own = [r for r in rows if r[0] == part and r[1][letter]]
                gone, alive = [r for r in alive if r[1][letter]], [r for r in alive if not r[1][letter]]
                shapley[letter] += len(gone)
                alone = [r for r in own if sum(r[1].values()) == 1]
                out[part, "".join(order), step] = [len(alive), len(gone), len(own) - len(gone), len(alone), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, docs, labels):
    df = spark.createDataFrame([(i, t, lang, 7, "x", None) for i, t, lang in docs], DOC)
    rows = audit(df, spark.createDataFrame([(*r, 1) for r in labels], LABEL)).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}


def test_against_all_orders(spark):
    long = " ".join(f"w{i}" for i in range(210))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (1, long, "en"), (3, long, "de"), (0, long + " $", "de"), (4, None, None), (5, "", ""), (6, "", "en"), (None, "", "en"), (None, long, "fr"),
        (7, "same " * 300, "en"), (8, "AB " * 250 + "é" * 40, "de"), (9, "\x1fA b\x0b# \x0c", "en"), (10, (long + "\n") * 3000, "en"), (11, (long + "\n") * 3000 + "|", None), (12, "\t \n", "fr"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, None, 1), (9, 1, None), (None, 1, 1), (99, 1, 1), (12, 0, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(1, "a", "en")], []) == brute([(1, "a", "en")], [])


def test_many_parts_and_six_letters(spark):
    cells = spark.createDataFrame([(f"p{i}", m, i + m, 1, 0) for i in range(300) for m in (0, 5, 63)], "part string, mask int, n long, good long, toxic long")
    out = interactions(cells, "ABCDEF")
    assert out.count() == 300 * 720 * 6
    row = out.where("part = 'p3' AND filter_order = 'CBAFED' AND step = 3").first()
    assert (row["kept"], row["removed"], row["redundant"], row["unique_fails"]) == (3, 0, 8 + 66, 0)
