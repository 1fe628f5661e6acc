"""Import every query module so the catalogue is complete."""

from driftkit.plans import catalog
from driftkit.plans import q_classify, q_closed_forms, q_functions, q_metrics, q_profile, q_regression, q_telemetry  # noqa: F401


def queries():
    return dict(catalog.QUERIES)


def oracles():
    return dict(catalog.ORACLES)
