"""A PySpark engine for variant identity, and operators for training data."""

from importlib import import_module

_WHERE = {
    "AssemblyNotDetectedError": "functions.assembly",
    "NAMESPACE": "functions.ids",
    "annotate_file": "operators.annotate",
    "Collection": "operators.collection",
    "hgvs_to_id": "operators.hgvs_convert",
    "id_to_hgvs": "operators.hgvs_convert",
    "VariantId": "scalar",
    "ReferenceNotFoundError": "sources.refgenome",
    "data_dir": "sources.refgenome",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(import_module(f"locuskey.{_WHERE[name]}"), name)
