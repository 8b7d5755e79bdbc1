"""The enrolment screening: from raw yearly files to ranked features."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.operators import clean, contingency, encode, logit, rank, scores
from crivo.operators.align import numbers_aligned
from crivo.shared import materialize, work_path
from crivo.sources.files import CORRUPT, SOURCE
from crivo.sources.sinks import write_partitions

# Names in the enrolment files.
SITUATION = "Categoria da Situacao"
DROPPED_OUT = "Evadidos"
IN_PROGRESS = "Em Curso"
TARGET = "Alvo_Evadido"
INCOME = "Renda Familiar"
FUNDING = "Fonte de Financiamento"
SCALED = (INCOME, FUNDING)
NOMINAL = (
    "Nome de Curso", "Instituicao", "Cor / Raca", "Turno", "Sexo", "Subeixo Tecnologico",
    "Tipo de Curso", "Tipo de Oferta", "Eixo Tecnologico", "Modalidade de Ensino",
    "Matricula Atendida", "Fonte de Financiamento", "Municipio", "Faixa Etaria",
)
MAPPED = ("Instituicao", "Nome de Curso", "Tipo de Oferta", "Tipo de Curso", "Turno")
NOT_TESTED = ("Numero de registros", "Matricula Atendida")
UNUSED = (
    "Ano", "Carga Horaria", "Carga Horaria Minima", "Idade",
    "Data de Fim Previsto do Ciclo", "Data de Inicio do Ciclo", "Data de Ocorrencia da Matricula",
    "Mes De Ocorrencia da Situacao",
    "Vagas Regulares AC", "Vagas Regulares l1", "Vagas Regulares l2", "Vagas Regulares l5",
    "Vagas Regulares l6", "Vagas Regulares l9", "Vagas Regulares l10", "Vagas Regulares l13",
    "Vagas Regulares l14",
    "Vagas Extraordinarias AC", "Vagas Extraordinarias l1", "Vagas Extraordinarias l2",
    "Vagas Extraordinarias l5", "Vagas Extraordinarias l6", "Vagas Extraordinarias l9",
    "Vagas Extraordinarias l10", "Vagas Extraordinarias l13", "Vagas Extraordinarias l14",
    "Total de Inscritos", "Fator Esforco Curso", "Numero de registros",
    "Codigo do Municipio com DV", "Codigo da Matricula", "Codigo do Ciclo Matricula",
    "Codigo da Unidade de Ensino - SISTEC", "Cod Unidade", "Co Inst",
    "Categoria da Situacao", "Situacao de Matricula", "Unidade de Ensino", "Regiao", "UF",
)

@dataclass(frozen=True)
class Preset:
    """Which columns are coded how, and what happens to rows with missing values."""

    label_columns: tuple[str, ...]
    one_hot_columns: tuple[str, ...] = ()
    also_dropped: tuple[str, ...] = ()
    keep_incomplete: bool = False
    strict_drop: bool = False
    exclude_situations: tuple[str, ...] = ()
    by_file: bool = False


LABELS_WITH_MISSING = Preset(NOMINAL, keep_incomplete=True, strict_drop=True)
LABELS = Preset(
    tuple(c for c in NOMINAL if c != "Matricula Atendida"), also_dropped=("Matricula Atendida",)
)
ONE_HOT = Preset((FUNDING,), tuple(c for c in NOMINAL if c != FUNDING))


@dataclass(frozen=True)
class Prepared:
    """The analysis table and its label dictionary; of a wide table also the narrow one before it, and the values of its columns."""

    table: DataFrame
    labels: encode.Labels | None
    one_hot_columns: tuple[str, ...]
    narrow: DataFrame | None = None
    values: dict[str, list[str]] | None = None


def cleaned(raw: DataFrame, preset: Preset) -> DataFrame:
    """Names and text cleaned, target derived, unused columns gone; categories still text."""
    df = clean.normalize_names(raw)
    if not preset.keep_incomplete:
        # Cleaning never makes a text missing, so incomplete rows can go before it. A column
        # that a file does not have is not missing in its rows.
        df = clean.drop_incomplete(df)
    df = clean.drop_present(df, [clean.ABSENT, CORRUPT])
    df = clean.clean_text(df, [c for c in clean.text_columns(df) if c != SOURCE])
    df = clean.binary_target(df, SITUATION, DROPPED_OUT, TARGET)
    df = clean.exclude_values(df, SITUATION, preset.exclude_situations)
    unused = [*UNUSED, *preset.also_dropped]
    df = clean.drop_strict(df, unused) if preset.strict_drop else clean.drop_present(df, unused)
    return encode.ordinal_encode(df, INCOME) if INCOME in df.columns else df


def prepare(raw: DataFrame, preset: Preset = LABELS, wide: bool = False) -> Prepared:
    """Clean and encode.

    ``raw`` is read once: the cleaned texts are written as Parquet, from which one pass fits all
    dictionaries and one encodes. One-hot columns stay text unless ``wide``, since the scores
    need only their counts.
    """
    df = cleaned(raw, preset)
    missing = encode.MISSING if preset.keep_incomplete else None
    by = [SOURCE] if preset.by_file and SOURCE in df.columns else []
    label_columns = clean.present(df, preset.label_columns)
    one_hot_columns = clean.present(df, preset.one_hot_columns)
    fitted = [*label_columns, *(one_hot_columns if wide else [])]
    if not fitted:
        return Prepared(df, None, tuple(one_hot_columns))
    df = materialize(df, "cleaned")
    labels = encode.fit_labels(df, fitted, by=by, missing_as=missing)
    coded = encode.encode_labels(df, labels, label_columns)
    if wide and one_hot_columns:
        if by:
            raise ValueError("one-hot columns need one dictionary for all files")
        values = encode.category_lists(labels, one_hot_columns)
        return Prepared(encode.one_hot_wide(coded, values), labels, tuple(one_hot_columns), coded, values)
    return Prepared(coded, labels, tuple(one_hot_columns))


def store(prepared: Prepared, path: str | None = None) -> Prepared:
    """Write the analysis table, one folder per source file, and go on from there.

    Rankings and training read the table several times; the written one is compact,
    pruned by column and by file, and free of the work of cleaning.
    """
    df = prepared.table
    spark = df.sparkSession
    folder = path or work_path(spark, "prepared")
    if SOURCE in df.columns and prepared.narrow is not None:
        # What is shuffled are the narrow rows; each task makes its own wide.
        spread = encode.one_hot_wide(prepared.narrow.hint("rebalance", SOURCE), prepared.values)
        write_partitions(spread.select(*[contingency.quoted(c) for c in df.columns]), folder, together=True)
    elif SOURCE in df.columns:
        write_partitions(df, folder)
    else:
        df.write.mode("overwrite").parquet(folder)
    return replace(prepared, narrow=None, values=None, table=spark.read.schema(df.schema).parquet(folder).select(*[contingency.quoted(c) for c in df.columns]))


def feature_columns(df: DataFrame, target: str = TARGET) -> list[str]:
    """All columns but the target and the file name."""
    return contingency.features_of(df, target, exclude=[SOURCE])


def rank_by_class_sums(df: DataFrame, target: str = TARGET, k: int = rank.TOP_K) -> DataFrame:
    """Best features by the class-sum score of label codes: ``feature, chi2_score, p_value``.

    Columns that are still text are label-encoded first, a missing value as a category.
    """
    df = clean.drop_present(df, [SOURCE])
    numbers = clean.for_chi_square(encode.encode_remaining_text(clean.for_chi_square(df, target), target), target)
    features = feature_columns(numbers, target)
    found = scores.class_sum_scores(contingency.class_sums(numbers, features, target))
    return scores.select_k_best(found, k, len(features))


def rank_by_association(df: DataFrame, target: str = TARGET, k: int = rank.TOP_K) -> DataFrame:
    """Bias-corrected V of the best features by class sums: ``feature, cramers_v``."""
    chosen = [c for c in rank.top_names(rank_by_class_sums(df, target, k), "chi2_score", k) if c not in NOT_TESTED]
    tests = scores.contingency_tests(contingency.contingency_table(df, chosen, target))
    return rank.ranked(scores.cramers_v(tests), "cramers_v")


def rank_full(prepared: Prepared, target: str = TARGET) -> DataFrame:
    """Presence-and-absence score over numeric and one-hot features, best first.

    Numeric features are summed by class after scaling; one-hot features are scored from
    the contingency counts of their columns. ``feature, chi2_score, cramers_v, p_value``.
    """
    df = prepared.table
    texts = list(prepared.one_hot_columns)
    parts = []
    numbers = [c for c in feature_columns(df, target) if c not in texts]
    if numbers:
        scaled = encode.scale_min_max(clean.to_numbers(df.select(*[contingency.quoted(c) for c in [*numbers, target]]), target), SCALED)
        parts.append(contingency.class_sums(scaled, numbers, target).withColumn("value", F.lit(None).cast("string")))
    if texts and texts[0] in df.columns:
        table = contingency.contingency_table(df, texts, target, keep_missing=True, n_classes=2)
        parts.append(contingency.one_hot_sums(table))
    sums = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rank.ranked(scores.full_scores(sums), "chi2_score")


def rank_wide(df: DataFrame, target: str = TARGET) -> DataFrame:
    """`rank_full` for a table that is wide already (parts read back, aligned to all columns)."""
    columns = [c for c in df.columns if c != SOURCE]
    scaled = encode.scale_min_max(numbers_aligned(df, columns, target), SCALED)
    features = feature_columns(scaled, target)
    return rank.ranked(scores.full_scores(contingency.class_sums(scaled, features, target)), "chi2_score")


def rank_by_model(
    prepared: Prepared, group: str = SOURCE, target: str = TARGET, incremental: bool = False, **options
) -> DataFrame:
    """Absolute coefficient of the averaged (or carried) logistic model: ``feature, importance``."""
    df = prepared.table
    texts = list(prepared.one_hot_columns)
    numbers = [c for c in contingency.features_of(df, target, exclude=[SOURCE, group]) if c not in texts]
    bounds = materialize(encode.merged_bounds(encode.min_max_by(df, SCALED, group)), "bounds")
    scaled = encode.scale_by(df, bounds, SCALED)
    train = logit.mixed_incremental_coefficients if incremental else logit.mixed_federated_coefficients
    return logit.importance(train(scaled, texts, numbers, target, group, **options))


def rank_by_global_model(prepared: Prepared, target: str = TARGET, **options) -> DataFrame:
    """Absolute coefficient of one logistic model over all rows: ``feature, importance``.

    Features are the numeric columns, scaled to [0, 1], and a 0/1 feature per category of
    whatever is text, one left out per column.
    """
    df = clean.drop_present(prepared.table, [SOURCE])
    texts = [c for c in feature_columns(df, target) if c in prepared.one_hot_columns or clean.is_text(df, c)]
    numbers = [c for c in feature_columns(df, target) if c not in texts]
    bounds = materialize(encode.min_max(df, numbers), "bounds") if numbers else None
    scaled = encode.scale_by(df, bounds, numbers) if numbers else df
    return logit.importance(logit.mixed_global_coefficients(scaled, texts, numbers, target, **options))
