"""Named operations: exact argument sets, validation, dispatch."""

from __future__ import annotations

from typing import Any

from lorespark.plans.catalogue import Catalogue
from lorespark.plans.evolutions import get_evolutions
from lorespark.plans.moves import get_level_up_moves, get_machine_moves, get_move_learning_methods
from lorespark.plans.sheet import get_identity, get_signature_moves, get_types

ENTRY_OPERATIONS = {"get_types": get_types, "get_identity": get_identity, "get_signature_moves": get_signature_moves}
GAME_OPERATIONS = {
    "get_evolutions": get_evolutions,
    "get_move_learning_methods": get_move_learning_methods,
    "get_level_up_moves": get_level_up_moves,
    "get_machine_moves": get_machine_moves,
}
# Arguments each operation takes besides operation, entity, form and version_group.
EXTRA_ARGUMENTS = {"get_move_learning_methods": ["move"], "get_level_up_moves": ["min_level", "max_level"]}


def _text(plan: dict, key: str, required: bool) -> str | None:
    value = plan.get(key)
    if value is None and not required:
        return None
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{key} must be a non-empty text" + ("" if required else " or null"))
    return value.strip()


def validate_plan(plan: dict[str, Any]) -> dict[str, Any]:
    """Cleaned plan; an unknown operation, a missing key or a spare key is an error."""
    operation = plan.get("operation")
    if operation not in ENTRY_OPERATIONS and operation not in GAME_OPERATIONS:
        raise ValueError(f"unsupported operation: {operation!r}")
    expected = {"operation", "entity", "form", "version_group", *EXTRA_ARGUMENTS.get(operation, [])}
    if set(plan) != expected:
        raise ValueError(f"{operation} takes exactly: " + ", ".join(sorted(expected)))
    result = {"operation": operation, "entity": _text(plan, "entity", True), "form": _text(plan, "form", False),
              "version_group": _text(plan, "version_group", False)}
    if operation in ENTRY_OPERATIONS and result["version_group"] is not None:
        raise ValueError("entry facts cannot be filtered by game")
    if "move" in expected:
        result["move"] = _text(plan, "move", True)
    if "min_level" in expected:
        for key in ("min_level", "max_level"):
            value = plan[key]
            if value is not None and (type(value) is not int or value < 0):
                raise ValueError(f"{key} must be null or a positive integer")
            result[key] = value
        if None not in (result["min_level"], result["max_level"]) and result["min_level"] > result["max_level"]:
            raise ValueError("min_level exceeds max_level")
    return result


def execute_plan(cat: Catalogue, plan: dict[str, Any]) -> dict[str, Any]:
    arguments = validate_plan(plan)
    operation = arguments.pop("operation")
    if operation in ENTRY_OPERATIONS:
        return ENTRY_OPERATIONS[operation](cat, arguments["entity"], arguments["form"])
    return GAME_OPERATIONS[operation](cat, **arguments)
