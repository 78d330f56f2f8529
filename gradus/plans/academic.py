"""Preset for academic records: students, term results, programmes, classes, curricula.

Fixed values: source names, column names, statuses, limits and labels that existing data and
downstream users rely on.
"""

from __future__ import annotations

from ..operators.features import FeatureSpec
from ..operators.quality import Rule
from ..operators.standardize import TableSpec, outside_domain
from .flow import FlowSpec
from ..sources.publish import JdbcTarget, Promotion
from .layers import Layers, StarSpec
from .modelling import VARIANTS, ModelSpec

# ------------------------------------------------------------------------------- fixed values
KNOWN_SOURCES = {
    "Referensi Data Mahasiswa": "data_referensi_mahasiswa",
    "Data KHS": "data_khs",
    "Data Program Studi": "data_program_studi",
    "Data Mata Kuliah": "data_mata_kuliah",
    "Data Kelas": "data_kelas",
    "Data Kurikulum": "data_kurikulum",
}
VALID_STATUSES = ("AKTIF", "LULUS", "DIKELUARKAN", "MENGUNDURKAN DIRI", "LAINNYA", "WAFAT")
GRADUATED, ACTIVE = "LULUS", "AKTIF"
ON_TIME, LATE = "Tepat Waktu", "Terlambat"
LIMIT_DAYS = 1460
FEATURES = ("ip", "sks", "angkatan", "jumlah_mk")
DENIED = (
    "jenis_kelamin", "tanggal_masuk", "tanggal_keluar", "ipk", "total_sks", "status_mahasiswa",
    "lama_studi", "status_kelulusan", "estimasi_semester", "persentase_sks",
)
PUBLISHED = ("gold_mahasiswa", "gold_program_studi", "gold_kurikulum")
PREDICTION_LABEL, PREDICTION_PROBABILITY = "prediksi_status_kelulusan", "probabilitas_prediksi"
PREDICTION_TABLE = "prediction_result"
MODEL_NAME, MODEL_VERSION = "gaussian_nb_lulusan", "v2.0.0"

# ------------------------------------------------------------------------------------- tables
STUDENTS = TableSpec(
    source="data_referensi_mahasiswa", target="silver_mahasiswa", key="id_mahasiswa",
    columns={
        "ID": "id_mahasiswa", "Jenis Kelamin": "jenis_kelamin", "Tanggal Masuk": "tanggal_masuk",
        "Tanggal Keluar": "tanggal_keluar", "IPK": "ipk", "Total SKS": "total_sks",
        "Jumlah MK": "jumlah_mk", "Status Mahasiswa": "status_mahasiswa",
    },
    casts={"tanggal_masuk": "date", "tanggal_keluar": "date", "ipk": "double", "total_sks": "int", "jumlah_mk": "int"},
    rules=(
        Rule("null_id", "id_mahasiswa IS NULL"),
        Rule("null_tanggal_masuk", "tanggal_masuk IS NULL", rejects=True),
        Rule("keluar_sebelum_masuk", "tanggal_keluar < tanggal_masuk", rejects=True),
        Rule("ipk_out_of_range", "ipk < 0 OR ipk > 4", rejects=True),
        Rule("ipk_null", "ipk IS NULL"),
        Rule("total_sks_negatif", "total_sks < 0"),
        Rule("jumlah_mk_negatif", "jumlah_mk < 0"),
        Rule("status_unknown", outside_domain("status_mahasiswa", VALID_STATUSES)),
        # a bare number such as a spreadsheet serial reads as a year; shown, not part of the total
        Rule("tanggal_tidak_wajar", "year(tanggal_masuk) NOT BETWEEN 1900 AND 2100", info=True),
    ),
)
TERM_RESULTS = TableSpec(
    source="data_khs", target="silver_khs", key="id_mahasiswa",
    columns={"ID": "id_mahasiswa", "IP": "ip", "SKS": "sks"},
    casts={"ip": "double", "sks": "int"},
    rules=(
        Rule("null_id", "id_mahasiswa IS NULL", rejects=True),
        Rule("null_ip", "ip IS NULL", rejects=True),
        Rule("null_sks", "sks IS NULL", rejects=True),
        Rule("ip_negatif", "ip < 0", rejects=True),
        Rule("ip_atas_4", "ip > 4", rejects=True),
        Rule("sks_negatif", "sks < 0", rejects=True),
        Rule("ip_sama_dengan_nol", "ip = 0", info=True),
        Rule("sks_sama_dengan_nol", "sks = 0", info=True),
    ),
)
PROGRAMMES = TableSpec("data_program_studi", "silver_program_studi", {
    "Kode": "kode", "Nama Program Studi": "nama_program_studi", "Jumlah Dosen": "jumlah_dosen"})
CLASSES = TableSpec("data_kelas", "silver_kelas", {
    "nama_kelas": "nama_kelas", "nama_mk": "nama_mk", "kuota": "kuota"})
CURRICULA = TableSpec("data_kurikulum", "silver_kurikulum", {
    "Nama Kurikulum": "nama_kurikulum", "Jumlah SKS Total": "jumlah_sks_total"})

STAR = StarSpec(
    key="id_mahasiswa",
    dim_source="silver_mahasiswa", dim_target="dim_mahasiswa",
    dim_columns=("id_mahasiswa", "jenis_kelamin", "tanggal_masuk", "tanggal_keluar", "ipk", "total_sks",
                 "jumlah_mk", "status_mahasiswa"),
    fact_source="silver_khs", fact_target="fact_khs", fact_columns=("id_mahasiswa", "ip", "sks"),
    measures=("ip", "sks"),
    pass_through={"silver_program_studi": "gold_program_studi", "silver_kurikulum": "gold_kurikulum"},
)
FEATURE_SPEC = FeatureSpec(
    key="id_mahasiswa", features=FEATURES, measures=("ip", "sks"), status="status_mahasiswa",
    start="tanggal_masuk", end="tanggal_keluar", limit_days=LIMIT_DAYS, on_time=ON_TIME, late=LATE,
    label="status_kelulusan", training_status=GRADUATED, inference_status=ACTIVE,
    derived=(("angkatan", "year(tanggal_masuk)"),), denied=DENIED,
)
FLOW = FlowSpec(
    tables=(STUDENTS, TERM_RESULTS, PROGRAMMES, CLASSES, CURRICULA),
    star=STAR, features=FEATURE_SPEC, known_sources=KNOWN_SOURCES,
)
MODEL = ModelSpec(
    key="id_mahasiswa", features=FEATURES, label="status_kelulusan", positive=ON_TIME,
    name=MODEL_NAME, version=MODEL_VERSION,
)


# --------------------------------------------------------------------------------------- sinks

def promotions(output: str, layers: Layers = Layers()) -> list[Promotion]:
    """What :func:`modelling.run_inference` leaves below ``output``, as tables of the feature store."""
    required = (MODEL.key, *FEATURES, PREDICTION_LABEL, PREDICTION_PROBABILITY,
                "prediction_timestamp", "model_version", "model_variant")
    names = tuple(f"prediction_{v}" for v, _ in VARIANTS)
    targets = [(f"prediction_result_{v}", required, PREDICTION_LABEL) for v, _ in VARIANTS]
    targets.append(("prediction_comparison", (MODEL.key, *names), None))
    return [Promotion(f"{output.rstrip('/')}/{name}", f"{layers.feature_store}.{name}", columns, label)
            for name, columns, label in targets]


def jdbc_targets(layers: Layers = Layers()) -> list[JdbcTarget]:
    """Tables published to a relational database."""
    return [JdbcTarget(f"{layers.gold}.{t}", t) for t in PUBLISHED]


def dashboard_tables(layers: Layers = Layers()) -> list[str]:
    """Tables that dashboards read."""
    return [*[f"{layers.gold}.{t}" for t in PUBLISHED], f"{layers.feature_store}.{PREDICTION_TABLE}"]
