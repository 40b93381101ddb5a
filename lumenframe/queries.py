"""All queries of the library but for the text operators, and their SQL, by name."""

from __future__ import annotations

from lumenframe.operators import channels, coding, curves, decoding, demix, dynamics, extensions, fields, fitted, gaussian, graph, landmarks, linear, moments, paths, planes, pruned, relations, sequence, spectral, summary
from lumenframe.plans import cross_suite, demixing_task, gaussian_task, rotation_task, static_task
from lumenframe.sources import designs

MODULES = (sequence, channels, summary, moments, graph, pruned, landmarks, spectral, fitted, extensions, gaussian_task, static_task, demixing_task, rotation_task, cross_suite, relations, linear, demix, decoding, coding, dynamics, fields, paths, planes, gaussian, curves, designs)
#: Simulations and fixed inputs: kept with their tests, but not registered, as they read none of the given tables.
TABLELESS = frozenset(
    "gp_posterior demixing skew_fit field_fit autoencoder label_shuffle_null covariance_shuffles linear_gaussian_results linear_gaussian_summary static_linear_results static_linear_summary demixing_results demixing_summary "
    "rotation_results rotation_summary cross_suite_synthesis kernels rank_condition timescale_select trajectory_inference hairpin_points hairpin_recovery circle_points circle_modes cell_designs turning_planes generated_counts".split()
)
EVERY = {k: f for m in MODULES for k, f in m.QUERIES.items()}
EVERY_ORACLE = {k: s for m in MODULES for k, s in m.ORACLES.items()}
QUERIES = {k: f for k, f in EVERY.items() if k not in TABLELESS}
ORACLES = {k: s for k, s in EVERY_ORACLE.items() if k not in TABLELESS}
