"""Design matrices: imputed, scaled and one-hot encoded features, fitted on training rows."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.prep import (
    apply_scaler,
    fit_medians,
    fit_modes,
    fit_scaler,
    pool_rare_categories,
)
from marketlens.operators.quantiles import frozen, with_row


def design_entries(
    df: DataFrame,
    numeric: list[str],
    categorical: list[str],
    train: str = "is_train",
    min_count: int = 50,
    method: str = "exact",
) -> tuple[DataFrame, list[Column], list[str]]:
    """The rows with their scaled numbers and the places of their categories' levels, the matrix's entries over these columns, and their names.

    The added columns are few, so they are what to store: entries are plain expressions, built anew in every scan. Medians, modes, means, deviations and category levels come from rows with ``train`` = 1.
    Every training level has its own entry and an unseen category is all zeros. A number that is missing or NaN after
    filling is an error.
    """
    fit_rows = df.filter(F.col(train) == 1)
    fills = with_row(fit_medians(fit_rows, numeric, method), fit_modes(fit_rows, categorical))
    fills = frozen(fills.select(*[F.col(c).alias(f"_fill_{c}") for c in numeric + categorical]))
    prepared = with_row(df, fills).select(
        *df.columns,
        *[F.coalesce(F.col(c).cast("double"), F.col(f"_fill_{c}")).alias(f"numeric__{c}") for c in numeric],
        *[F.coalesce(c, f"_fill_{c}").alias(f"categorical__{c}") for c in categorical],
    )
    numbers = [f"numeric__{c}" for c in numeric]
    groups = [f"categorical__{c}" for c in categorical]
    is_train = F.col(train) == 1
    prepared = apply_scaler(prepared, numbers, frozen(fit_scaler(prepared.filter(is_train), numbers)))
    prepared = pool_rare_categories(prepared, groups, prepared.filter(is_train), min_count)

    levels = [f"{c}_level" for c in groups]
    indexer = StringIndexer(
        inputCols=levels,
        outputCols=[f"{c}_index" for c in levels],
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    fitted = indexer.fit(prepared.filter(is_train))
    scaled = [F.col(f"{c}_z") for c in numbers]
    bad = F.raise_error(F.lit("Encountered null or NaN in a scaled number of the design matrix.")).cast("double")
    placed = fitted.transform(prepared).select(
        *df.columns,
        *[F.when(z.isNull() | F.isnan(z), bad).otherwise(z + F.lit(0.0)).alias(f"_number_{i}") for i, z in enumerate(scaled)],
        *[F.col(c).cast("int").alias(f"_place_{i}") for i, c in enumerate(indexer.getOutputCols())],
    )
    entries, names = [F.col(f"_number_{i}") for i in range(len(numbers))], list(numbers)
    for i, (group, labels) in enumerate(zip(groups, fitted.labelsArray, strict=True)):
        entries += [(F.col(f"_place_{i}") == place).cast("double") for place in range(len(labels))]
        names += [f"{group}_{label}" for label in labels]
    return placed, entries, names


def design_matrix(
    df: DataFrame,
    numeric: list[str],
    categorical: list[str],
    train: str = "is_train",
    min_count: int = 50,
    method: str = "exact",
) -> tuple[DataFrame, list[str]]:
    """Add a ``features`` vector of the entries to every row; returns it with their names."""
    placed, entries, names = design_entries(df, numeric, categorical, train, min_count, method)
    return placed.select(*df.columns, array_to_vector(F.array(*entries)).alias("features")), names
