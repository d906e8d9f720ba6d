"""Session analytics for click and page-view logs, as DataFrame operators."""
