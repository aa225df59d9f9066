"""A small labelled corpus with insults, copies and a secret."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
INSULTS = ["idiot", "moron", "worthless"]


def toxic_tables(spark, n=240):
    rng = random.Random(3)
    syllables = ["th", "on", "er", "ing", "and", "tion", "re", "sha"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        text = " ".join(words) + ("." if i % 6 else " password=abc123def456.")
        docs.append((i, text, "en", rng.choice(["s0", "s1", None]), len(text)))
        labels.append((i, 1, int(toxic)))
        if i % 10 == 3:
            docs.append((1000 + i, text.replace(".", ""), "en", "s0", len(text)))
    docs += [(5000, None, None, None, None), (5001, "", "en", "s1", 0)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
