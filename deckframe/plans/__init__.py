"""Plan helpers: tables written between jobs, running sums over sorted ranges, size-checked broadcasts, free column names."""

from deckframe.plans.tables import fresh, running, sized, stored, work_dir

__all__ = ["fresh", "running", "sized", "stored", "work_dir"]
