"""Who may run what, when: access control, the services database, admission and the query service."""
