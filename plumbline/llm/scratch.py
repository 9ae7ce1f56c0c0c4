"""Tables that cut lineage, as the rest of the library writes them."""

from plumbline.scratch import _MADE, LOCAL_DEFAULT, Table, clear, kept_alone, saved, shared_dir

__all__ = ["_MADE", "LOCAL_DEFAULT", "Table", "clear", "kept_alone", "saved", "shared_dir"]
