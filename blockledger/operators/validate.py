"""The ledger of blocks already checked, and what is left to check."""

from pyspark.sql import DataFrame

from blockledger.schema import KEY


def to_validate(local: DataFrame, ledger: DataFrame, ignore_previous=False) -> DataFrame:
    blocks = local.select(*KEY).distinct()
    return blocks if ignore_previous else blocks.join(ledger.select(*KEY), KEY, "left_anti")


def mark_validated(ledger: DataFrame, checked: DataFrame) -> DataFrame:
    return ledger.select(*KEY).unionByName(checked.select(*KEY)).distinct()
