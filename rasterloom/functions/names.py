"""Names without collisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def unique_names(files: DataFrame) -> DataFrame:
    """(batch, ord, name, unique_name): names in order; a taken one gets (2), (3), ... before its extension.

    A name that a suffix has made counts as taken too, so this is one fold over each batch.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", ignore_index=True)
        taken: set[str] = set()
        following: dict[str, int] = {}
        out = []
        for name in pdf["name"]:
            unique = name
            if name in taken:
                dot = name.rfind(".")
                base, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
                i = following.get(name, 2)
                while (unique := f"{base}({i}){ext}") in taken:
                    i += 1
                following[name] = i
            taken.add(unique)
            out.append(unique)
        return pdf[["batch", "ord", "name"]].assign(unique_name=out)

    return files.select("batch", "ord", "name").groupBy("batch").applyInPandas(fold, "batch long, ord long, name string, unique_name string")
