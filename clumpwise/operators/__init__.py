"""DataFrame operators on structures, particles and cells."""
