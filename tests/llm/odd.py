"""Documents that operators must not stumble over."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, `group` long, bucket int, shard int, slot int, kept string, places string, fp string, "
    "component_id string, ids string, _text string, _kept string, host string, n_lines string, _score string, x string, size long, lost string"
)
EXTRA = [7, 8, 9, 10, "k", "p", "f", "c", "i", "t", "kk", "h", "n", "s", "x", 3, "l"]


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "the", "of", "été", "ß", "中文", "x1", "#tag", "end."]
    passage = " ".join(rng.choice(words) + str(i) for i in range(45))
    out = []
    for i in range(n):
        t = " ".join(rng.choice(words) + (str(rng.randint(0, 400)) if rng.random() < 0.7 else "") for _ in range(rng.randint(1, 120)))
        if i % 5 == 0:
            t = t + "\n" + passage + "\n" + t[: len(t) // 3]
        if i % 7 == 0:
            t = "Same line on every page\n" + t
        out.append((i, t, "en", f"src{i % 3}", len(t)))
    out += [
        (None, "no id at all " * 30, None, None, None), (None, None, None, None, None), (n, None, "en", "src0", 0), (n + 1, "", "en", "src0", 0), (n + 2, " \t\n\x0b\x0c\r ", "en", None, 6),
        (n + 3, "word", "en", "src1", 4), (n + 4, "same same same " * 400, "en", "src1", 6000), (n + 5, ("long " + passage + " ") * 300, "en", "src2", 1), (n + 6, "a" * 20_000, "en", "src2", 1),
        (n + 7, out[3][1], "en", "src0", 1), (n + 8, out[3][1], "en", "src0", 1), out[5], out[5], (n + 9, "don't <|endoftext|> stop\x00\x1f\x85    it's", "xx", "src0", 2),
    ]
    return out


def docs(spark, given=None):
    return spark.createDataFrame([tuple(r) + tuple(EXTRA) for r in (rows() if given is None else given)], SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
