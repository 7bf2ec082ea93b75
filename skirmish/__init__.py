"""skirmish: combat-log analytics and event/text preparation on PySpark.

The package is organised by role: ``sources`` read and write, ``functions`` are
pure column expressions, ``operators`` are DataFrame-to-DataFrame steps,
``plans`` compose them into queries and reports, ``streaming`` runs the same
state machines on live input.
"""
