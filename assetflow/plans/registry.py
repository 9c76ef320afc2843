"""All registered queries: name -> (Spark query, SQL equivalent or None)."""

from __future__ import annotations

from assetflow.plans import attestation, files, imaging, library, metrics

REGISTRY = {**library.REGISTRY, **metrics.REGISTRY, **attestation.REGISTRY, **imaging.REGISTRY, **files.REGISTRY}
