"""Small tables with every odd case: nulls, empty and long texts, repeated rows, columns with names that operators use inside."""
import random

KINDS = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, `row` string, slot int, position double, kept boolean, component long, hash long, `order` string"
EXTRA = ("x", "y", "z", 7, 0.5, True, 9, 3, "o")

VOCABULARY = [a + b for a in ("ba", "do", "ké", "lu", "mi", "no", "ra", "su", "the", "of") for b in ("", "n", "rt", "l.", "s,", "ñ")]


def prose(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", " ", " ", "\n", "  "]) for _ in range(n))


def odd_texts():
    long = prose(99, 30_000)
    return [None, "", " \t\n\x0b\f\r ", "one", "two words", "A B c", "a b C", "\xa0nbsp\x1cis no blank\x85", prose(1, 120), prose(1, 120), prose(2, 300),
            prose(2, 299) + "end", long, "the the the the the the", "line\nline\nline\n\n", "# * $ % & | < >", "é" * 60 + " " + "日本語 テキスト"]


def table(spark, texts, sources=None, ids=None):
    rows = []
    for k, text in enumerate(texts):
        key = ids[k] if ids else k
        source = sources[k] if sources else (None if k % 5 == 4 else f"s{k % 3}")
        rows.append((key, text, None if k % 2 else "en", source, None if text is None else len(text), *EXTRA))
    return spark.createDataFrame(rows, KINDS)


def odd(spark):
    """Odd texts, with a repeated id, a repeated row and a null id."""
    texts = odd_texts()
    ids = [*range(len(texts)), 3, 8, None]
    texts = [*texts, "another text of id three", texts[8], "a text without an id"]
    return table(spark, texts, ids=ids)
