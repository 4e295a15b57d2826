"""Small tables with nulls, empty and very long texts, ties, repeated rows and extra columns of clashing names."""

TEXTS = [
    (1, "the of and to a in that it is was for on are as with his they at be this have from or one had by word"),
    (2, ""),
    (3, None),
    (4, "x" * 70_000 + " end"),
    (5, "naïve café — ça va?  two  spaces\n\n\tand tabs\r\n \U0001f600 中文 12 34's"),
    (6, "the of and to a in that it is was for on are as with his they at be this have from or one had by word"),
    (6, "the of and to a in that it is was for on are as with his they at be this have from or one had by word"),
    (7, " "),
    (8, "a"),
    (9, "be " * 400),
    (10, "Bonjour, le monde est à nous et la vie est belle. " * 40),
    (None, "a row without key"),
    (12, "!!!! ...."),
    (13, "ends here <|endoftext|> and goes on <|endoftext|>, <|endoftext"),
    (14, "word, Word. word.\nOther's, it's. ça. naïve, é. 12. a1, don't."),
]


def documents(spark, rows=TEXTS):
    """Columns of documents and some that clash with operators' own."""
    full = [(k, t, None if k in (2, 9) else ("fr" if k == 10 else "en"), f"src{(k or 0) % 2}", len(t or ""), 7, "x") for k, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, score string")


def saved(spark, path, df, name="documents"):
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
