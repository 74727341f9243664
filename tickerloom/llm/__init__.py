"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Every operator names its
id and text columns and reads only those.  Functions that keep rows whole
(``drop_copies``, ``drop_near_copies``, the stages of the pipeline) choose their own
names so that extra columns of any name stay as they are.
"""
