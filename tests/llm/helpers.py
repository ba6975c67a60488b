"""A small corpus with the awkward cases: nulls, empty and long texts, ties,
repeated rows, extra columns whose names the operators use inside."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, key string, node long, leaks string, score double"


def corpus(seed=3):
    rnd = random.Random(seed)
    words = ["the", "of", "Straße", "and", "thing", "éa", "on", "WORD", "two", "x1", "ñu", "end.", "line,", "alpha", "beta", "gamma"]
    prose = lambda n: " ".join(rnd.choice(words) + str(rnd.randint(0, 40)) for _ in range(n))
    passage = "A passage that many of these documents share, " + prose(90)
    line = "This Frequent line has well over forty characters in it, äöü"
    texts = [None, "", "   \n\t", "one", "two words", "TWO WORDS", "two words", prose(3000), passage, "short\n\n" + line + "\nend"]
    base = prose(150)
    for k in range(30):
        t = base.split()
        for _ in range(k % 4):
            t[rnd.randrange(len(t))] = f"edit{rnd.randint(0, 5)}"
        texts.append(" ".join(t))
    for k in range(20):
        texts.append("\n".join([prose(rnd.randint(5, 60)), "  " + (line.upper() if k % 3 == 0 and False else line) + " \r", passage if k % 2 else "", prose(10)]))
    texts += ["word " * 400, "ab" * 700, prose(80), prose(80)]
    texts += [base, base, base.upper(), passage]
    rows = [(i, t, "en", "s", len(t or ""), 7, "k", 5, "l", 0.5) for i, t in enumerate(texts)]
    rows.append((None, "a row without an id " + prose(5), "en", None, None, None, None, None, None, None))
    rows.append(rows[12])
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
