"""Small hostile tables shared by the tests."""

import random

DOCS = "doc_id long, text string"
#: The same rows with further columns whose names the operators use themselves.
CLASHING = DOCS + ", fingerprint string, score string, lang_pred string, ids string, key string, secret_spans string, repeated_ranges string, lang string, source string, n_chars long"


def widened(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "i", "k", "s", "r", None, "src", 0) for i, t in rows], CLASHING)


def hostile_texts(seed: int = 2, n: int = 60) -> list[tuple[int, str | None]]:
    """Random texts that copy from each other, with runs, periods, multi-byte characters, an empty, a null, a long and repeated rows."""
    rng, docs = random.Random(seed), []
    for i in range(n):
        words: list[str] = []
        while len(words) < rng.choice([0, 30, 60, 200]):
            k = rng.random()
            if k < 0.35 and docs:
                own = rng.choice(docs)[1].split()
                if len(own) > 3:
                    at = rng.randrange(len(own))
                    words += own[at : at + rng.choice([49, 50, 51, 60, 90])]
            elif k < 0.5:
                words += [rng.choice("abé")] * rng.choice([1, 2, 3, 5, 60])
            elif k < 0.6:
                words += rng.choice([["x", "y"], ["x", "y", "z"]]) * rng.choice([5, 30])
            else:
                words += [rng.choice(["of", "the", "été", "🎉", str(rng.randrange(50))]) for _ in range(rng.randint(1, 30))]
        docs.append((i, rng.choice([" ", " ", "\n", "  "]).join(words)))
    docs += [(1000, None), (1001, ""), (1002, docs[5][1]), (1003, " \n "), (1004, "longword " * 3000 + "end")]
    return docs + [docs[7], docs[7]]
