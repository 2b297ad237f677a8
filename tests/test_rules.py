import datetime as dt

import pytest
from pyspark.sql import functions as F

from helixlake.functions import scalars as S


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string"] * len(values), strict=True))) if values else spark.range(1)
    return tuple(row.select(*columns).first())


def test_numbers(spark):
    raw = ["1.5", "NaN", "Infinity", "-inf", "", None, "x", "1e3"]
    df = spark.createDataFrame([(r,) for r in raw], "c string")
    assert [r[0] for r in df.select(S.finite_or_null(F.col("c"))).collect()] == [1.5, None, None, None, None, None, None, 1000.0]
    assert [r[0] for r in df.select(S.fraction(F.col("c"))).collect()][-1] == 10.0


def test_length_and_chain_groups(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 20.0, 20.5, 50.0, 100.0, 200.0, 201.0, float("nan"), None, -1.0)], "n double")
    assert [r[0] for r in df.select(S.length_group(F.col("n"))).collect()] == ["1-20", "1-20", "21-50", "21-50", "51-100", "101-200", ">200", None, None, None]
    assert [r[0] for r in df.select(S.chain_count_group(F.col("n"))).collect()][-3:-1] == ["unknown", "unknown"]


def test_split_bounds(spark):
    days = [dt.date(2023, 12, 31), dt.date(2024, 1, 1), dt.date(2024, 12, 31), dt.date(2025, 1, 1), None]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.select(S.chronological_split(F.col("d"), dt.date(2023, 12, 31), dt.date(2024, 12, 31))).collect()]
    assert got == ["train", "val", "val", "test", None]


def test_chain_labels(spark):
    def brute(n):
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    df = spark.range(0, 18280)
    assert all(r[1] == (brute(r[0]) if 1 <= r[0] <= 18278 else None) for r in df.select("id", S.chain_label(F.col("id"))).collect())


def test_ids_sequences_and_symbols(spark):
    c = F.col("c")
    assert one(spark, S.normalise_id(c), S.normalise_id(F.lit("1a_b")), S.normalise_id(F.lit("1a_b"), True), c=" 1abc ") == ("1ABC", None, "1A_B")
    assert one(spark, S.search_alphabet(c), S.count_of(S.search_alphabet(c), "N"), S.unknown_symbols(c), c="ACGUNXN") == ("ACGTNNN", 3, "NX")
    assert one(spark, S.residue_tokens(c), c="A(PSU)G?")[0] == ["A", "(PSU)", "G", "?"]
    assert one(spark, S.atom_name(c), S.sample_file(F.lit("1ABC_x_s3_best.pt"))["seed"], S.residue_letter(F.lit("GUA")), S.residue_letter(F.lit("PSU"), F.lit("u")), S.residue_letter(F.lit("?")), c=" o5* ") == ("O5'", 3, "G", "U", "X")


@pytest.mark.parametrize(("length", "want"), [(1022, [0]), (1023, [0, 1]), (1533, [0, 511]), (2880, [0, 766, 1532, 1858]), (3774, [0, 766, 1532, 2298, 2752])])
def test_window_starts(spark, length, want):
    assert one(spark, S.window_starts(F.lit(length), 1022, 256))[0] == want


def test_rescue_reasons_need_all_markers_of_a_class(spark):
    text = "Computing RMSD ... Computing patch TM-score"
    assert one(spark, S.rescue_reason(F.lit(False), F.lit(text)), S.rescue_reason(F.lit(False), F.lit(text + " ERROR! No assignable chain")), S.rescue_reason(F.lit(True), F.lit(text))) == (None, "DOWNSTREAM_TM_NO_ASSIGNABLE_CHAIN_AFTER_RMSD", None)


def test_structure_classes(spark):
    got = one(spark, S.structure_class(F.lit("70S with tRNA"), F.lit(""), F.lit("")), S.structure_class(F.lit("x"), F.lit("50s subunit"), F.lit("")), S.structure_class(F.lit("x"), F.lit(None), F.lit("Polypeptide(L) polyribonucleotide")), S.structure_class(F.lit("x"), F.lit(""), F.lit("polyribonucleotide")), S.is_pure_rna(F.array(F.lit("Polyribonucleotide"), F.lit("polyribonucleotide"))))
    assert got == ("ribosome_bound", "ribosome", "rna_protein", "pure_rna", True)
