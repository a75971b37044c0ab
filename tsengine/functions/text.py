"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def url_file_name(url: Column) -> Column:
    """Text after the last slash; empty for an empty URL."""
    return F.substring_index(url, "/", -1)


# Fields of the run key, in order, with their prefixes.
_HEAD = [("task_name", ""), ("model_id", ""), ("model", ""), ("data", ""), ("features", "ft"),
         ("seq_len", "sl"), ("label_len", "ll"), ("pred_len", "pl"), ("d_model", "dm"),
         ("n_heads", "nh"), ("e_layers", "el"), ("d_layers", "dl"), ("d_ff", "df")]
_VARIATIONAL = [("embed", "eb"), ("inter_dim", "id"), ("latent_dim", "ld"), ("revin", "revin")]
_PLAIN = [("factor", "fc"), ("embed", "eb"), ("distil", "dt")]
_TAIL = [("des", ""), ("itr", "")]


def _fields(config: dict, variational: bool) -> list[tuple[str, str]]:
    fields = _HEAD + (_VARIATIONAL if variational else _PLAIN) + _TAIL
    lacking = [name for name, _ in fields if name not in config]
    if lacking:
        raise ValueError(f"run key needs {', '.join(lacking)}")
    return fields


def run_name(config: dict, variational: bool = True) -> str:
    """Run name of one configuration of plain values, its fields in a fixed order."""
    return "_".join(f"{prefix}{config[name]}" for name, prefix in _fields(config, variational))


def run_key(config: dict, variational: bool = True) -> Column:
    """The same as a column; values of ``config`` are columns or plain values."""

    def text(value) -> Column:
        return value.cast("string") if isinstance(value, Column) else F.lit(str(value))

    parts = [F.concat(F.lit(prefix), text(config[name])) for name, prefix in _fields(config, variational)]
    return F.concat_ws("_", *parts)
