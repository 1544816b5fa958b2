"""DataFrame operators over observations, facts and graphs."""
