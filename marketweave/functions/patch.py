"""Edits of open-ended attributes kept as JSON: a patch is merged into a document, and null in it removes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Objects within objects that a patch may have; a deeper one fails.
DEPTH = 12
_MAP = "map<string, variant>"


def _is(v: Column, kind: str) -> Column:
    """Whether a variant is an object, or JSON's null; a missing one is neither."""
    said = F.schema_of_variant(v)
    return F.coalesce(said.startswith("OBJECT<") if kind == "object" else said == "VOID", F.lit(False))


def _merged(target: Column, patch: Column, depth: int) -> Column:
    """patch, an object, merged into target: members of both without those that are null in the patch; its members that are objects are merged in turn."""
    held = F.when(_is(target, "object"), target.cast(_MAP)).otherwise(F.create_map().cast(_MAP))
    said = patch.cast(_MAP)

    def member(_: Column, old: Column, new: Column) -> Column:
        inner = _merged(old, new, depth - 1) if depth > 1 else F.raise_error(F.lit(f"a patch of more than {DEPTH} objects within each other")).cast("variant")
        return F.when(new.isNull(), old).when(_is(new, "object"), inner).otherwise(new)

    removed = F.map_keys(F.map_filter(said, lambda _, v: _is(v, "null")))
    return F.to_variant_object(F.map_filter(F.map_zip_with(held, said, member), lambda k, _: ~F.array_contains(removed, k)))


def merge_variant(target: Column, patch: Column) -> Column:
    """The merge patch of two variants: a patch that is no object replaces the target; a null (missing) patch changes nothing."""
    return F.when(patch.isNull(), target).when(_is(patch, "object"), _merged(target, patch, DEPTH)).otherwise(patch)


def merge_patch(target: Column, patch: Column) -> Column:
    """As merge_variant, of JSON texts: members come in the order of their names. A text that is no JSON counts as missing."""
    return F.to_json(merge_variant(F.try_parse_json(target), F.try_parse_json(patch)))
