"""marketgrid: retail-district analytics on Spark DataFrames.

Sub-packages: ``sources`` (readers, stand-in tables, sinks), ``functions``
(column expressions), ``operators`` (ranking, quantiles, joins), ``plans``
(the analyses), ``streaming`` (intentionally empty, see its docstring).
"""
