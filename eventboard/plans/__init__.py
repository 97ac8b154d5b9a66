"""Named plans: rules of the sources, page-to-observation jobs and the registered queries."""
