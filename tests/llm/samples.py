import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, text_2 string, n string"
WORDS = {x: [f"{x}{a}{b}" for a in "bdfgklmnprst" for b in ("a", "en", "io", "ur", "ée")] for x in ("wo", "zü", "ña")}


def prose(rng, n, lang="wo"):
    out = []
    for k in range(n):
        w = rng.choice(WORDS[lang])
        out.append(w.capitalize() + ("." if k % 9 == 8 else "") if k % 9 == 0 else w + ("." if k % 9 == 8 else ""))
    return "\n".join(" ".join(out[i : i + 40]) for i in range(0, n, 40))


def texts():
    """Texts with copies, near copies, shared passages, junk, notices, and awkward cases."""
    rng = random.Random(5)
    base = [prose(rng, n, lang) for n, lang in ((60, "wo"), (120, "zü"), (300, "ña"), (90, "wo"), (2500, "zü"), (7, "wo"), (3, "ña"))]
    near = base[1].split(" ")
    near[40] = "changed"
    hub = [" ".join([*base[3].split(" ")[:k], f"x{k}", *base[3].split(" ")[k + 1 :]]) for k in (5, 25, 45, 65)]
    passage = prose(rng, 70)
    shared = [prose(rng, 50) + "\n" + passage + "\n" + prose(rng, 40) for _ in range(3)]
    junk = [" ".join(w.upper() + "!!" for w in prose(rng, 80).split()), "echo " * 200, "a b c " * 60 + prose(rng, 30), "| ".join(prose(rng, 90).split())]
    notices = ["Released under the MIT License.\n" + prose(rng, 60), prose(rng, 55) + "\nAll rights reserved. CC BY, cc by", "GNU General Public License\nGeneral public-license"]
    odd = [None, "", " \n\t ", "a", "é" * 210, "x" * 450, "\U0001f600 " * 120, "one two three four", "one two three four", "\x1c　  ", "<|endoftext|> a <|endoftext|>", "KKİ CC BY"]
    return base + [base[0], base[0], base[4], " ".join(near), *hub] + shared + junk + notices + odd


def frame(spark, values, ids=None):
    rows = [(i if ids is None else ids[i], t, ("en", "de", "fr", None)[i % 4], "src0", len(t or ""), "s", "k", "t", None) for i, t in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)
