"""Imports every catalog module so that its queries are registered."""

from ledgerloom.plans import (  # noqa: F401
    catalog_documents,
    catalog_hierarchy,
    catalog_invoices,
    catalog_jobs,
    catalog_matching,
    catalog_portfolio,
    catalog_scalars,
    catalog_text,
)
