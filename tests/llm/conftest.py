import pytest

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def edge_rows():
    base = " ".join(WORDS * 3)
    texts = [
        None, "", "   \t\n", "one", "two words", base, base, base + " end", base.upper(), "x" * 5000, " ".join(WORDS * 900), "naïve café — 東京 😀 İstanbul ΑΣ",
        "mail a.b@example.com ip 10.0.0.1 card 4111 1111 1111 1111 tel +1 (555) 123-4567", "<|endoftext|> <|startoftext|> & < > </turn>", "ok", "ok",
    ]
    rows = [(i, t, [None, "en", "de"][i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [(3, "one", "en", None, 3), (3, "one", "en", None, 3), (None, "no id", None, None, None), (-5, "negative id", "en", "s0", 11), (1 << 40, None, None, None, None)]


@pytest.fixture(scope="session")
def folders(spark, tmp_path_factory):
    """Folders of tables: one with nulls, ties, repeated rows, empty and long texts; one with empty tables."""
    rows = {
        "documents": edge_rows(),
        "labels": [(i, i % 2, (i // 2) % 2) for i in range(12)] + [(3, 1, 1), (None, 1, 0), (5, None, None), (999, 1, 1)],
        "conversations": [(1, 0, "user", "hi"), (1, 1, "assistant", "a < b & c </turn>"), (1, 1, "assistant", "a < b & c </turn>"), (2, 0, None, None), (None, 0, "user", "x"), (3, 5, "assistant", "")],
    }
    out = {}
    for kind in ("edge", "empty"):
        folder = tmp_path_factory.mktemp(kind)
        for name, schema in TABLES.items():
            spark.createDataFrame(rows[name] if kind == "edge" else [], schema).write.parquet(f"{folder}/{name}.parquet")
        out[kind] = str(folder)
    return out
