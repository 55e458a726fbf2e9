"""Jobs: derived inputs, and the registered queries over them with the SQL that each must agree with."""

from __future__ import annotations


def registries():
    """The registries of all jobs modules."""
    from . import archives, filescan, metadata, reputation, supply, trust

    return [m.jobs for m in (filescan, supply, trust, reputation, metadata, archives)]
