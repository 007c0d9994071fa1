"""Spark operators for robot-trajectory, video-clip, caption and evaluation tables.

Every operator takes and returns DataFrames (or Columns); nothing is collected to
the driver and nothing larger than a stated bound is held by a single task.
"""

__version__ = "0.1.0"
