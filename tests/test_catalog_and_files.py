"""Catalog, drift, scans, inventory and sinks on small literal inputs."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from visitline.functions import names as N
from visitline.operators import catalog as C, drift as D, integrity as I
from visitline.sources import inventory as V, sinks as K, tables as S

DICT = "FLDNAME string, TBLNAME string, TEXT string, TYPE string, UNITS string, position int"


@pytest.mark.parametrize(
    "name, source, text, role",
    [
        ("RID", "", "", "identifier"), ("RID_x", "", "", "identifier"), ("DX_bl", "", "", "baseline_diagnosis"), ("DX", "", "", "label"),
        ("VISCODE2", "", "", "visit_time"), ("EXAMDATE_UCSFFSX", "", "", "visit_time"), ("SITE", "", "", "administrative"),
        ("ABETA_UPENNBIOMK9_04_19_17", "UPENNBIOMK9", "", "csf"), ("FA_CST_L", "DTIROI", "", "mri_dti"), ("x", "", "mean diffusivity", "mri_dti"),
        ("FDG", "", "", "pet_fdg"), ("x", "UCBERKELEYAV45", "", "pet_amyloid"), ("x", "UCBERKELEYAV1451", "", "pet_other"),
        ("ST101SV", "UCSFFSX", "", "mri_structural"), ("AGE", "", "", "demographic"), ("MMSE_bl", "", "", "cognitive"),
        ("APOE4", "", "", "genetic"), ("y", "", "Prescription drug", "medication"), ("y", "", "family history", "medical_history"),
        ("y", "", "plasma level", "biofluid_other"), ("Ventricles_bl", "ADNIMERGE", "", "mri_structural"), ("Ventricles", "", "", "unknown"),
    ],
)
def test_roles(spark, name, source, text, role):
    df = spark.range(1).select(N.column_role(F.lit(name), F.lit(source), F.lit(text)).alias("r"))
    assert df.first()["r"] == role


def test_families(spark):
    df = spark.createDataFrame([("Hippocampus_UCSFFSX_11_02_15",), ("Hippocampus_bl",), ("MMSE",)], "c string")
    assert [r[0] for r in df.select(N.measurement_family(F.col("c"))).collect()] == ["HIPPOCAMPUS", "HIPPOCAMPUS", "MMSE"]


def test_encoded_names(spark):
    df = spark.createDataFrame([("num__AGE",), ("PTGENDER_Male",), ("PTGENDER=F",), ("AGED",)], "f string")
    got = [r[0] for r in df.select(N.encoded_feature_group(F.col("f"), [("demo", "AGE"), ("demo2", "PTGENDER")])).collect()]
    assert got == ["demo", "demo2", "demo2", "other"]


def test_dictionary_prefers_the_fuller_entry(spark):
    entries = [("fldname", "TBLNAME", "TEXT", "TYPE", "UNITS", 0), ("Age", "", "", "", "", 1), ("AGE", "T", "age", "", "", 2), ("age", "U", "age", "", "", 3)]
    got = C.match_dictionary(spark.createDataFrame([("AgE",), ("other",), ("FLDNAME",)], "column_name string"), spark.createDataFrame(entries, DICT), "position")
    assert {r["column_name"]: r["TBLNAME"] for r in got.collect()} == {"AgE": "T", "other": None, "FLDNAME": None}


def test_catalog_blocks_and_selects(spark):
    data = [(1, "bl", "CN", 30.0, 200.0), (2, "bl", "AD", 20.0, None), (3, "m06", "MCI", 25.0, 150.0)]
    df = spark.createDataFrame(data, "RID int, VISCODE string, DX string, MMSE double, ABETA_UPENNBIOMK9_04_19_17 double")
    entries = [("MMSE", "ADNIMERGE", "score", "N", "", 0), ("ABETA_UPENNBIOMK9_04_19_17", "UPENNBIOMK9", "CSF", "N", "", 1)]
    catalog = C.build_catalog(df, spark.createDataFrame(entries, DICT), "position", min_count=1)
    use = {r["column_name"]: r["recommended_use"] for r in catalog.collect()}
    assert use == {"RID": "exclude_identifier", "VISCODE": "exclude_leakage", "DX": "exclude_leakage", "MMSE": "include_primary",
                   "ABETA_UPENNBIOMK9_04_19_17": "include_primary"}
    assert rows(C.whitelist(catalog)) == [("ABETA_UPENNBIOMK9_04_19_17",), ("MMSE",)]
    assert C.feature_groups(catalog, ["MMSE"]) == {"cognitive": ["MMSE"]}
    with pytest.raises(ValueError, match="missing"):
        C.feature_groups(catalog, ["nope"])
    with pytest.raises(ValueError, match="sparse"):
        C.feature_groups(catalog, ["ABETA_UPENNBIOMK9_04_19_17"])
    with pytest.raises(ValueError):
        C.build_catalog(df, spark.createDataFrame(entries, DICT), "position", per_family=0)


def test_quota_and_cap(spark):
    data = [(f"c{i}", "genetic", 0.1 * i, False, False, "include_optional") for i in range(8)] + [("d", "demographic", 0.9, False, False, "include_optional")]
    df = spark.createDataFrame(data, "column_name string, role string, missing_rate double, dictionary_match boolean, available_in_scoring boolean, recommended_use string")
    pick = lambda cap: sorted(r[0] for r in C.whitelist(C.select_primary(df, cap)).collect())
    assert pick(200) == ["c0", "c1", "c2", "c3", "c4", "d"]  # five genetic at most
    assert pick(3) == ["c0", "c1", "d"]  # demographic comes first


def test_profile_treats_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (1.0, None)], "x double, s string")
    got = {r["column_name"]: (round(r["missing_rate"], 4), r["non_missing_count"], r["unique_count"]) for r in C.column_profile(df).collect()}
    assert got == {"x": (0.3333, 2, 1), "s": (0.3333, 2, 1)}


def test_shift_measures(spark):
    rng = random.Random(3)
    a = [rng.gauss(0, 1) for _ in range(400)]
    b = [rng.choice([rng.gauss(0.5, 1), 0.0]) for _ in range(300)]
    got = D.numeric_shift(spark.createDataFrame([(x,) for x in a], "v double"), spark.createDataFrame([(x,) for x in b], "v double"), ["v"]).first()
    grid = sorted(set(a) | set(b))
    ks = max(abs(sum(x <= g for x in a) / 400 - sum(x <= g for x in b) / 300) for g in grid)
    assert got["ks_statistic"] == pytest.approx(ks)
    s = np.sqrt((np.var(a, ddof=1) + np.var(b, ddof=1)) / 2)
    assert got["standardized_mean_difference"] == pytest.approx((np.mean(b) - np.mean(a)) / s)
    edges = np.quantile(a, [i / 10 for i in range(1, 10)])
    share = lambda v: np.maximum(np.bincount(np.searchsorted(edges, v, side="left"), minlength=10) / len(v), 1e-6)
    assert got["psi"] == pytest.approx(float(np.sum((share(b) - share(a)) * np.log(share(b) / share(a)))))


def test_approximate_profile(spark):
    df = spark.range(2000).select((F.col("id") % 500).alias("a"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("b"))
    exact = {r["column_name"]: r for r in C.column_profile(df).collect()}
    near = {r["column_name"]: r for r in C.column_profile(df, relative_error=0.02).collect()}
    for name in ("a", "b"):
        assert near[name]["missing_rate"] == exact[name]["missing_rate"] and near[name]["non_missing_count"] == exact[name]["non_missing_count"]
        assert abs(near[name]["unique_count"] / exact[name]["unique_count"] - 1) < 0.1


def test_unseen_levels_have_no_limit(spark):
    train = spark.createDataFrame([("a",)], "s string")
    scoring = spark.createDataFrame([("c",), ("b",), ("a",), (None,)], "s string")
    assert rows(D.unseen_levels(train, scoring, ["s"])) == [("s", 2)]
    assert rows(D.unseen_level_rows(train, scoring, ["s"])) == [("s", "b"), ("s", "c")]
    many = spark.range(120_000).select(F.col("id").cast("string").alias("s"))
    got = {r["feature"]: r["unseen_levels"] for r in D.schema_compatibility(train, many, ["s"]).collect()}
    assert got == {"s": 120_000}


def test_outcome_matching(spark):
    outcomes = spark.createDataFrame([(1, "2021-01-01", "NL"), (1, "2021-06-01", "possible AD"), (9, "2021-01-01", "CN")], "RID int, ScanDate string, Diagnosis string")
    index = spark.createDataFrame([(1, "2020-01-01")], "RID int, EXAMDATE string")
    got = D.match_outcomes(outcomes, index, "RID", "EXAMDATE", "ScanDate", "Diagnosis").collect()
    by = {(r["RID"], r["ScanDate"]): r for r in got}
    assert by[1, "2021-01-01"]["match_outcome"] == "included" and 12.0 < by[1, "2021-01-01"]["forecast_months"] < 12.1
    assert by[1, "2021-01-01"]["outcome_label"] == 0
    assert by[1, "2021-06-01"]["match_outcome"] == "unresolved_label" and by[9, "2021-01-01"]["match_outcome"] == "unmatched_subject"


def test_reproduction_check(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.25)], "k int, p double")
    assert I.reproduced(a, a, ["k"], ["p"]).first()["reproduced"]
    assert not I.reproduced(a, a.withColumn("p", F.col("p") + 1e-9), ["k"], ["p"]).first()["reproduced"]
    assert not I.reproduced(a, a.where("k = 1"), ["k"], ["p"]).first()["reproduced"]


def test_sentinel_scan(spark, tmp_path):
    (tmp_path / "t.csv").write_text(' RID , MMSE,DX,extra\n1,-4,CN,1\n2, ,"a\nb",2\n3,30,-4.0,3\n')
    raw = S.read_csv(spark, str(tmp_path / "t.csv"))
    assert raw.columns == ["RID", "MMSE", "DX", "extra"]
    got = S.pruned_scan(raw, ["RID", "MMSE", "DX"], numeric=["MMSE"])
    assert rows(got) == [("1", None, "CN"), ("2", None, "a\nb"), ("3", 30.0, None)]
    with pytest.raises(ValueError, match="absent, gone"):
        S.pruned_scan(raw, ["RID", "gone", "absent"])
    with pytest.raises(FileNotFoundError):
        S.read_csv(spark, str(tmp_path / "none.csv"))
    numbers = spark.createDataFrame([(-4, -4.0), (1, float("nan")), (2, 2.0)], "i int, d double")
    assert rows(S.null_missing(numbers)) == sorted([(None, None), (1, None), (2, 2.0)], key=repr)


def test_dictionary_scan(spark, tmp_path):
    (tmp_path / "d.csv").write_text("FLDNAME,TBLNAME,TEXT,TYPE,UNITS\n AGE ,-4,None,,nan\n")
    assert tuple(S.read_dictionary(spark, str(tmp_path / "d.csv")).first()) == ("AGE", "", "", "", "")
    with pytest.raises(ValueError):
        S.clean_dictionary(spark.createDataFrame([("a",)], "FLDNAME string"))


CSV_FILES = {
    "ADNIMERGE_like.csv": ("RID,VISCODE,DX,MMSE,ADAS13,Hippocampus,FDG\n1,bl,CN,29,10,7000,1.2\n", "merged_adnimerge"),
    "dictionary_x.csv": ("FLDNAME,TBLNAME,TEXT\na,b,c\n", "data_dictionary"),
    "DXSUM.csv": ("RID,VISCODE,DXCHANGE\n1,bl,1\n", "diagnosis"),
    "PTDEMOG.csv": ("RID,PTGENDER,PTEDUCAT\n1,2,16\n", "demographics"),
    "APOERES.csv": ("RID,APGEN1,APGEN2\n1,3,4\n", "apoe"),
    "sub/MMSE.csv": ("RID,VISCODE,MMSCORE\n1,bl,30\n", "cognitive"),
    "FreeSurfer.csv": ("RID,ST101SV,ST29SV\n1,3000,4000\n", "mri_measurement"),
    "UCBERKELEYAV45.csv": ("RID,SUMMARYSUVR\n1,1.2\n", "pet_measurement"),
    "UPENNBIOMK9.CSV": ("RID,ABETA,TAU,PTAU\n1,200,80,20\n", "biofluid_csf"),
    "MRI_manifest.csv": ("IMAGEUID,note\n1,x\n", "mri_manifest_or_image_metadata"),
    "Items.csv": ("RID,ADASQ4,FAQ,ITEMVOLUMEA,ITEMVOLUMEB\n1,1,2,x,y\n", "cognitive"),
    "hippo.csv": ("RID,VISCODE,LEFTHIPPO,RIGHTHIPPO\n1,bl,3100,3200\n", "mri_measurement"),
    "suffixed.csv": ("RID,VISCODE,ABETA_UPENNBIOMK9_04_19_17\n1,bl,900\n", "biofluid_csf"),
    "plain.csv": ("foo,bar\na,b\n", "unknown"),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for name, (text, _) in CSV_FILES.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    (root / "empty.csv").write_text("")
    (root / "latin.csv").write_bytes("RID,nåme\n1,é\n2,\n".encode("latin-1"))
    (root / "quoted.csv").write_text('RID,text\n1,"a\nb"\n2,c\n')
    (root / "not_a_table.txt").write_text("x")
    cell = "\n".join(f"line {i}" for i in range(40))
    (root / "long.csv").write_text("RID,VISCODE,DX,note\n" + "".join(f'{i},bl,CN,"{cell}"\n' for i in range(60)))
    (root / "wide.csv").write_text("a,b\n1,2\n1,2,3\n")
    return root


def test_inventory(spark, folder):
    inventory = V.scan_folder(spark, str(folder)).collect()
    by = {r["file"].split("raw")[-1].split("/", 1)[1]: r for r in inventory}
    assert set(by) == {*CSV_FILES, "empty.csv", "latin.csv", "quoted.csv", "long.csv", "wide.csv"}
    long = by["long.csv"]
    assert (long["read_status"], long["rows"], long["primary_category"]) == ("ok", 60, "diagnosis")
    assert (by["wide.csv"]["read_status"], by["wide.csv"]["read_error"]) == ("failed", "ParserError")
    assert {n: by[n]["primary_category"] for n in CSV_FILES} == {n: c for n, (_, c) in CSV_FILES.items()}
    assert by["empty.csv"]["read_status"] == "failed" and by["empty.csv"]["rows"] is None
    assert by["latin.csv"]["column_names"] == ["RID", "nåme"] and by["latin.csv"]["read_status"] == "ok"
    assert by["quoted.csv"]["rows"] == 2
    assert [(m["column"], m["rate"]) for m in by["latin.csv"]["missing_rate_top10"]] == [("nåme", 0.5), ("RID", 0.0)]
    assert [r["file"].lower() for r in inventory] == sorted(r["file"].lower() for r in inventory)


def test_group_availability(spark, folder):
    inventory = V.scan_folder(spark, str(folder)).where("not file rlike 'UCBERKELEY|ADNIMERGE|UPENN|suffixed'")
    got = {r["key"]: r for r in V.group_availability(inventory).collect()}
    assert not got["pet_measurement"]["available"] and got["apoe"]["matched_columns"] == ["APGEN1", "APGEN2"]
    assert got["diagnosis"]["available"] and got["demographic"]["available"]


def test_upsert_replaces_one_task(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "task_mode string, v int")
    new = spark.createDataFrame([("a", 9, "n")], "task_mode string, v int, extra string")
    assert rows(K.replace_task_rows(old, new, "a"), "task_mode", "v", "extra") == sorted([("b", 2, None), ("a", 9, "n")], key=repr)
    path = str(tmp_path / "out")
    K.upsert_task(old, path)
    K.upsert_task(new, path)
    assert rows(K.read_tasks(spark, path), "task_mode", "v") == [("a", 9), ("b", 2)]


def test_hashes_detect_changes(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(b"frozen")
    registry = K.file_hashes(spark, str(tmp_path)).collect()
    assert registry[0]["sha256"] == hashlib.sha256(b"frozen").hexdigest()
    frame = spark.createDataFrame(registry, "path string, sha256 string")
    K.assert_unchanged(frame, K.file_hashes(spark, str(tmp_path)))
    (tmp_path / "m.bin").write_bytes(b"changed")
    with pytest.raises(RuntimeError):
        K.assert_unchanged(frame, K.file_hashes(spark, str(tmp_path)))
