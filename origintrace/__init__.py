"""Attribution of social-media accounts and posts to sponsoring countries, as Spark jobs."""
